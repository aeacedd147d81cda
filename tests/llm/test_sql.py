"""The operators' queries against their SQL, and what every query must return."""

import duckdb
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry
from tallyline.llm.queries import ORACLES, QUERIES

#: leading columns of each query
COLUMNS = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id n_shingles component_id kept",
    "op5": "query_id rank vec_id score",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id size source_size target taken",
    "op11": "doc_id fingerprint component_id",
    "op12": "word form root n n_near form_n",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    """Integers of a column with nulls come as doubles from one side."""
    if pd.isna(v):
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_are_registered(spark):
    assert {n.split("_")[0] for n in QUERIES} == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    for name in ("op6_pii", "op8_shard", "op10_mix"):
        columns = QUERIES[name](spark, SF).columns
        want = COLUMNS[name.split("_")[0]].split()
        assert columns[:len(want)] == want
