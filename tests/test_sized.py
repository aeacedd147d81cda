"""Plans that hold at any size of the tables."""

import pytest
from pyspark.sql import functions as F

from tallyline import lexicon, session
from tallyline.operators import extraction
from tallyline.operators.tokens import tokenize
from tallyline.plans import corpus
from tallyline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_vocabulary_is_the_side_that_is_sent(spark):
    """Runs of tokens are never broadcast, whatever their estimated size."""
    texts = spark.range(50).select("id", F.lit("en").alias("lang"), F.lit("more or less twelve boxes").alias("text"))
    small = spark.createDataFrame([("en", "unit", "boxes", 1)], "lang string, class string, phrase string, n_tokens int")
    for words, rows in ((small, 50), (lexicon.lexicon_frame(spark), 150)):
        hits = lexicon.match_phrases(tokenize(texts), words, "id")
        assert "BuildLeft" not in plan_of(hits) and "BuildRight" in plan_of(hits)
        assert hits.count() == rows


def test_a_large_vocabulary_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "SMALL_VOCABULARY", 1)
    texts = spark.range(50).select("id", F.lit("en").alias("lang"), F.lit("more or less twelve boxes").alias("text"))
    hits = lexicon.match_phrases(tokenize(texts), lexicon.lexicon_frame(spark), "id")
    assert "ShuffledHashJoin" in plan_of(hits) and "BuildLeft" not in plan_of(hits)
    assert hits.count() == 150


def test_every_text_is_worked_on_once(spark):
    """A value made per call is the same for all rows of a text, and rows keep their own columns."""
    said = [(i, "en" if i % 2 else None, ["two boxes", "", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(said + [(60, "es", "two boxes")], "id long, lang string, text string")
    out = extraction.per_text(df, lambda t, text, lang: t.withColumn("call", F.expr("uuid()"))).collect()
    assert sorted((r.id, r.lang, r.text) for r in out) == sorted(said + [(60, "es", "two boxes")])
    assert len({r.call for r in out}) == 3


def test_per_text_equals_row_by_row(spark):
    said = ["twelve boxes of bolts in bin A-14", "about 3 boxes of tape", "several reels of wire in aisle two shelf 3",
            "", None, "  ", "doce cajas de pernos en el bin C 7", "TWELVE boxes of bolts in bin A-14"]
    df = spark.createDataFrame([(i, [None, "en", "es", "fr"][i // 8], said[i % 8]) for i in range(32)] * 2,
                               "id long, lang string, text string")
    for work in (extraction.extract, extraction.location_value, extraction.quantity_value):
        want = work(df, "text", "lang")
        got = extraction.per_text(df, work).select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    want = extraction.extract_items(df.distinct(), "id").select("id", "item_no", "parse")
    got = extraction.per_text(df.distinct(), lambda t, text, lang: extraction.extract_items(
        t, [text, lang], text, lang)).select("id", "item_no", "parse")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("query", [
    "qty_unit", "item_desc", "multi_item", "review", "certainty", "confidence", "loc_extract", "corrections_inline",
    "edit_values", "article_qty", "backend_units"])
def test_queries_parse_different_texts(spark, query):
    """The parser stands above the different texts, not above the rows."""
    plan = QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [text_key" in plan


def test_edits_meet_the_rules_of_their_own_field(spark, monkeypatch):
    """A quantity's value never reaches the location rules, and equal values reach their own once."""
    from tallyline.operators import edits as ed
    seen = []
    plain = ed.location_value

    def counted(t, *names):
        seen.append(t.count())
        return plain(t, *names)

    monkeypatch.setattr(ed, "location_value", counted)
    e = spark.createDataFrame(
        [(str(i), "en", ["location", "quantity", "item", "unit", None][i % 5], ["bin A-1", "20", "tape", "reels", "x"][i % 5])
         for i in range(100)], "id string, language string, field string, value string")
    places = spark.createDataFrame([("LOC-A-1", "Bin A-1", ["A-1"])], "id string, name string, aliases array<string>")
    parts = spark.createDataFrame([("PN-1", "tape", ["tapes"])], "part_number string, name string, aliases array<string>")
    out = ed._understand(e, places, parts)
    assert seen == [1]
    found = sorted((int(r.id), r._lid, r._q, r._pid) for r in out.collect())
    assert found == [(i, *[("LOC-A-1", None, None), (None, 20.0, None), (None, None, "PN-1"), (None,) * 3, (None,) * 3][i % 5])
                     for i in range(100)]


def test_the_correction_log_is_dealt_by_its_rows(spark, monkeypatch):
    """Tasks grow with the table, not the rows of a task; one exchange of the line items serves all steps."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    tasks = -(-lines // 500)
    assert plan_of(corpus.correction_log(spark, SF)).count("hashpartitioning(l_orderkey#") == 1
    assert f", {tasks})" in plan_of(corpus.correction_log(spark, SF))
    small = sorted(map(repr, QUERIES["correction_rate"](spark, SF).collect()))
    monkeypatch.undo()
    assert session.tasks_for(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert small == sorted(map(repr, QUERIES["correction_rate"](spark, SF).collect()))


def test_documents_are_dealt_ahead_of_extraction(spark):
    """A file of one row group is not parsed by one task."""
    assert "hashpartitioning(doc_id#" in plan_of(QUERIES["document_extract"](spark, SF))
