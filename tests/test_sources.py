"""Readers and writers of files, and the SQL functions."""

import json

from tallyline import sources
from tallyline.functions.sql import register

DOC = {
    "locations": [{"id": "L1", "name": "Bin A-14", "aliases": ["A-14"]}],
    "parts": [{"part_number": "P1", "name": "Plug", "aliases": []}, {"part_number": "P2", "name": "Jack"}],
    "units": [{"name": "skid", "aliases": ["skids"], "language": "en"}],
}


def test_combined_document(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps(DOC, indent=1))
    found = sources.read_refdata(spark, str(tmp_path))
    assert {k: v.count() for k, v in found.items()} == {"locations": 2, "parts": 4, "units": 2}
    assert {r.name for r in found["parts"].collect()} == {"Plug", "Jack"}


def test_dimensions(spark, tmp_path):
    for kind, rows in DOC.items():
        (tmp_path / f"{kind}.json").write_text(json.dumps(rows))
        got = sources.read_dimension(spark, str(tmp_path / f"{kind}.json"), kind)
        assert got.count() == len(rows) and "aliases" in got.columns


def test_json_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    sources.write_json(spark.createDataFrame([(1, None), (2, "x")], "id long, item string"), path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert [json.loads(x) for x in lines] == [{"id": 1, "item": None}, {"id": 2, "item": "x"}]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT fold('ÁRBOL') AS f, canon_code('A-14 /b') AS c, similarity('abcd', 'abcx') AS s, "
                    "similarity('', '') AS e").first()
    assert tuple(row) == ("arbol", "a14b", 0.75, 1.0)
