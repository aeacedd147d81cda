"""Merges, checks, snapshots and ingest against what they must not get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from tallyline import sources
from tallyline.functions import text as tx
from tallyline.operators import frames as fr
from tallyline.operators import records as rec
from tallyline.streaming import ingest


def test_owner_is_the_base_or_the_first_to_arrive(spark):
    shape = "id string, device_id string, status string, arrival long"
    base = spark.createDataFrame([("a", "own", "draft", 5)], shape)
    batch = spark.createDataFrame([
        ("a", "thief", "synced", 0), ("a", "thief", "synced", 9), ("a", "own", "confirmed", 1), ("a", "own", "synced", 2),
        ("b", "late", "synced", 4), ("b", "early", "draft", 3)], shape)
    got = {r.id: (r.device_id, r.status) for r in rec.upsert(base, batch, "arrival").collect()}
    assert got == {"a": ("own", "synced"), "b": ("early", "draft")}


def test_quantities_over_all_doubles(spark):
    values = [1e38, 1.7e308, 7e22, 1e23, 1e15 + 0.5, 2.5e-300, 0.1, 2e-3, -3.25, 0.0, 12.0, 123456789.125, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "q double").select("q", tx.format_quantity("q").alias("s"))
    for r in df.collect():
        assert float(r.s) == r.q and "e" not in r.s.lower()
        digits = r.s.replace("-", "").replace(".", "").strip("0")
        assert len(digits) <= len(repr(r.q).split("e")[0].replace("-", "").replace(".", "").strip("0"))


def test_no_number_stays_none(spark):
    df = spark.createDataFrame([(math.nan,), (2.0,), (-1.0,), (None,)], "x double").select(tx.clamp01("x").alias("x"))
    got = [r.x for r in df.collect()]
    assert math.isnan(got[0]) and got[1:] == [1.0, 0.0, 0.0]


def test_long_numbers_count(spark):
    words = ["9" * 300, "0" * 320 + "7", "1." + "0" * 400, "9" * 400, "1,200", "x9"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(tx.is_number("w").alias("n"))
    assert [r.n for r in df.collect()] == [True, True, True, False, True, False]


@pytest.mark.parametrize(("text", "legal"), [
    ("00c0b1a2-0000-7000-8000-00000000000a", True), ("urn:uuid:00c0b1a2-0000-7000-8000-00000000000a", True),
    ("{00c0b1a2-0000-7000-8000-00000000000a}", True), ("00c0b1a20000700080000000000000" + "0a", True),
    ("{00c0b1a2-0000-7000-8000-00000000000a", False), ("00c0b1a2-0000-7000-8000-00000000000", False), ("", False)])
def test_spellings_of_an_id(spark, text, legal):
    df = spark.createDataFrame([(text,)], "id string").withColumns({
        "captured_at": F.current_timestamp(), "status": F.lit("draft"), "language": F.lit("en"),
        "schema_version": F.lit(1), "parsed": F.struct(F.lit(1.0).alias("quantity")),
        "confidence": F.struct(*[F.lit(1.0).alias(n) for n in ("asr", "quantity", "location", "item")])})
    assert (df.select(rec.invalid_reason().alias("r")).first().r is None) == legal


def test_snapshots_are_replaced_only_when_they_change(spark, tmp_path):
    root = str(tmp_path / "parts")
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert sources.current_snapshot(spark, root) is None
    assert sources.refresh_snapshot(one, root) == "modified"
    assert sources.refresh_snapshot(one.orderBy(F.desc("id")), root) == "not_modified"
    assert sources.refresh_snapshot(one.where("id = 1"), root) == "modified"
    assert sources.read_snapshot(spark, root).count() == 1
    assert sources.current_snapshot(spark, root).version == 2


RECORD = ("id string, device_id string, captured_at timestamp, language string, status string, "
          "parsed struct<quantity:double>, confidence struct<asr:double,quantity:double,location:double,item:double>, "
          "schema_version int")


def _row(n, device, status, quantity=1.0):
    import datetime as dt
    return (f"00000000-0000-7000-8000-{n:012x}", device, dt.datetime(2000, 1, 1 + n % 3), "en", status,
            (quantity,), (1.0, 1.0, 1.0, 1.0), 1)


def _statuses(df):
    return {r.id[-2:]: (r.device_id, r.status) for r in df.collect()}


def test_ingest_of_many_files_and_batches(spark, tmp_path):
    batches = [[_row(i, "d1", "draft") for i in range(6)] + [_row(90, "d1", "draft", -1.0)],
               [_row(i, "d1", "synced") for i in range(3)] + [_row(4, "d2", "rejected")],
               [_row(1, "d1", "synced")]]
    log, point, source = (str(tmp_path / n) for n in ("log", "point", "in"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORD).parquet(source)
        ingest.run_ingest(stream, log, point)
        ingest.run_ingest(stream, log, point)  # a replay finds nothing new
    stored = RECORD + ", arrival struct<batch:int,place:long>"
    accepted = spark.read.schema(stored).parquet(f"{log}/accepted")
    rejected = spark.read.parquet(f"{log}/rejected")
    assert accepted.count() == 11 and [r.reason for r in rejected.collect()] == [rec.INVALID["negative"]]
    want = {f"{i:02x}": ("d1", "synced" if i < 3 else "draft") for i in range(6) if i != 5}
    voids = spark.createDataFrame([(_row(5, "", "")[0],)], "id string")
    assert _statuses(ingest.current_records(accepted, voids)) == want

    # the same rows as one batch give the same records
    ok, bad = ingest.validate_split(spark.createDataFrame([r for b in batches for r in b], RECORD))
    whole = ok.withColumn("arrival", F.struct(F.lit(0).alias("batch"), F.monotonically_increasing_id().alias("place")))
    assert _statuses(ingest.current_records(whole, voids)) == want and bad.count() == 1

    # compaction touches only the dates of the log, and merges the same
    first = accepted.where("arrival.batch = 0")
    merged = ingest.compact(accepted.where("arrival.batch > 0"), first, str(tmp_path / "base"))
    dates = {r[0] for r in accepted.where("arrival.batch > 0").select(F.to_date("captured_at")).distinct().collect()}
    assert {r[0] for r in merged.select(F.to_date("captured_at")).distinct().collect()} == dates
    both = merged.unionByName(first.join(merged.select("id"), "id", "left_anti").select(*merged.columns))
    assert _statuses(both.join(voids, "id", "left_anti")) == want


def test_the_last_samples_belong_to_an_open_utterance(spark):
    level = [0.3 * math.sin(2 * math.pi * 440 * i / fr.RATE) for i in range(9_933)]
    clips = spark.createDataFrame([("c", level)], "clip_id string, pcm array<float>")
    frames = fr.frame_features(clips)
    without = fr.vad_segments(frames).first()
    whole = fr.vad_segments(frames, tails=fr.frame_tails(clips)).first()
    assert whole.start_sample == without.start_sample
    assert whole.end_sample == 9_933 and without.end_sample == 9_600


def test_phrases_as_long_as_the_vocabulary_has_them(spark):
    from tallyline import lexicon
    from tallyline.operators.tokens import tokenize
    words = spark.createDataFrame([("en", "unit", "big blue box set", 4), ("en", "unit", "big", 1)],
                                  "lang string, class string, phrase string, n_tokens int")
    said = tokenize(spark.createDataFrame([(1, "en", "a big blue box set")], "k int, lang string, text string"))
    assert [tuple(r) for r in lexicon.match_phrases(said, words, "k").collect()] == [(1, 1, "unit", 4)]
