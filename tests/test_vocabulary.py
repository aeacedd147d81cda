"""Backend units joined ahead of extraction."""

import pytest

from tallyline.operators.extraction import extract_items
from tallyline.operators.vocabulary import extract_with_units, said_words, with_unit_words

UNITS = [
    (" Tarima ", ["TARIMAS", "", "tárima chica"], "es"),
    ("Skid", ["skids", "skid"], "en"),
    ("Tote", None, ""),
    ("crate", ["boxes"], None),
    ("  ", ["ghost"], "en"),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "name string, aliases array<string>, language string")


def found(spark, units, *said):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(said)], "k long, lang string, text string")
    rows = extract_with_units(df, units, "k").orderBy("k").collect()
    return [(r.parse.quantity, r.parse.unit, r.canonical_unit, r.parse.item_text) for r in rows]


def test_units_of_the_language_and_of_all(spark, units):
    assert found(
        spark, units, ("en", "four skids bolts in bin A-1"), ("es", "cuatro skids bolts"), ("es", "dos tárimas tornillos"),
        ("en", "two totes bolts"), ("en", "two tote bolts"), ("fr", "two skid bolts"), ("en", "two ghost bolts"),
    ) == [
        (4.0, "skids", "skid", "bolts"), (4.0, None, None, "skids bolts"), (2.0, "tárimas", "tarima", "tornillos"),
        (2.0, None, None, "totes bolts"), (2.0, "tote", "tote", "bolts"), (2.0, "skid", "skid", "bolts"),
        (2.0, None, None, "ghost bolts"),
    ]


def test_the_built_in_table_answers_first(spark, units):
    (_, unit, canonical, _), = found(spark, units, ("en", "two boxes of bolts"))
    assert (unit, canonical) == ("boxes", "box")


def test_rows_without_units_stay_as_they_are(spark, units):
    df = spark.createDataFrame([(1, "en", None), (2, "en", ""), (3, None, "two skid bolts"), (3 + 1, "en", "skid skid")],
                               "k long, lang string, text string")
    rows = {r.k: r.unit_words for r in with_unit_words(df, units, "k").collect()}
    assert rows == {1: [], 2: [], 3: ["skid"], 4: ["skid"]}
    none = units.limit(0)
    assert [r.unit_words for r in with_unit_words(df, none, "k").collect()] == [[]] * 4


def test_words_are_told_once_and_without_numbers(spark):
    df = spark.createDataFrame([(1, "en", "Two skid, skid 14 boxes")], "k long, lang string, text string")
    assert sorted(r._uf for r in said_words(df, "k").collect()) == ["skid", "two"]


def test_several_items_with_backend_units(spark, units):
    df = spark.createDataFrame([(1, "en", "two skids of bolts and three totes of nuts and 4 tote washers")],
                               "k long, lang string, text string")
    items = extract_items(with_unit_words(df, units, "k"), "k", unit_words="unit_words").orderBy("item_no").collect()
    assert [(r.parse.quantity, r.parse.unit, r.parse.item_text) for r in items] == [
        (2.0, "skids", "bolts"), (3.0, "totes", "nuts"), (4.0, "tote", "washers")]


def test_the_table_is_not_brought_to_the_plan(spark, units):
    """Unit rows stay a joined side: none of their words is a literal of the plan."""
    df = spark.range(3).selectExpr("id AS k", "'en' AS lang", "concat(id, ' skid bolts') AS text")
    plan = extract_with_units(df, spark.read.parquet(_kept(units)), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "skids" not in plan


def _kept(df):
    import tempfile
    path = f"{tempfile.mkdtemp()}/units"
    df.write.parquet(path)
    return path
