"""Chunked ordering, audio folds and ingest against direct computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import frames as fr
from tallyline.operators.ordered import _placed, lagged, last_n, numbered, trailing


def _events(n=400):
    rng = random.Random(3)
    # device a holds most of the rows
    return [("a" if rng.random() < 0.7 else "b", i, rng.randint(0, 99)) for i in range(n)]


@pytest.fixture
def many_partitions(spark):
    """Small rows keep all their range partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_a_hot_key_spans_partitions(spark, many_partitions):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.pow("id", F.lit(2)).cast("long").alias("o")).unionAll(
        spark.range(50).select(F.concat(F.lit("c"), F.col("id").cast("string")), F.col("id")))
    sizes = [r.n for r in _placed(df, ["k"], "o").where("k = 'hot'").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 8000


def test_numbered_lagged_trailing_last(spark, many_partitions):
    rows = _events()
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(3, "v")
    seen, want = {}, {}
    for k, o, v in rows:
        past = seen.setdefault(k, [])
        want[o] = (len(past) + 1, past[-1] if past else None, sorted((past + [v])[-5:]))
        past.append(v)
    got = {r.o: r.rn for r in numbered(df, ["k"], "o").collect()}
    assert got == {o: w[0] for o, w in want.items()}
    got = {r.o: r.p for r in lagged(df, ["k"], "o", "v", "p").collect()}
    assert got == {o: w[1] for o, w in want.items()}
    got = {r.o: r.t for r in trailing(df, ["k"], "o", "v", 5, "t", bucket=11).collect()}
    assert got == {o: w[2] for o, w in want.items()}
    got = {r.k: r.l for r in last_n(df, ["k"], "o", "v", 7, "l", salts=4).collect()}
    assert got == {k: vs[-7:] for k, vs in seen.items()}


def test_null_keys_are_one_key_and_no_rows_are_none(spark, many_partitions):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, None)], "k string, o long, v long")
    assert sorted((r.k or "", r.o, r.rn) for r in numbered(df, ["k"], "o").collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]
    assert {(r.k, r.o): r.p for r in lagged(df, ["k"], "o", "v", "p").collect()} == {
        (None, 1): None, (None, 2): 5, ("a", 1): None}
    assert numbered(df.limit(0), ["k"], "o").count() == 0


def test_numbers_shuffle_rows_once(spark):
    """Behind the written order only summaries are shuffled: one row per key and partition."""
    plan = numbered(spark.range(90).selectExpr("id % 3 AS k", "id AS o"), ["k"], "o")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("FileScan") <= 2


RATE = 16000


def _tone(hz, n, level):
    return [level * math.sin(2 * math.pi * hz * i / RATE) for i in range(n)]


def _quiet(n):
    rng = random.Random(1)
    return [0.001 * (rng.random() * 2 - 1) for _ in range(n)]


def _segments(spark, pcm, **cfg):
    df = spark.createDataFrame([("c", [float(x) for x in pcm])], "clip_id string, pcm array<float>")
    return fr.vad_segments(fr.frame_features(df), cfg=cfg).orderBy("utt_no").collect()


def test_one_utterance(spark):
    s = _segments(spark, _quiet(RATE // 2) + _tone(440, RATE, 0.3) + _quiet(RATE))
    assert len(s) == 1 and not s[0].truncated
    assert 0.75 * RATE <= s[0].end_sample - s[0].start_sample <= 2 * RATE


def test_silence_and_hiss(spark):
    assert _segments(spark, _quiet(RATE * 2)) == []
    assert _segments(spark, [0.3 if i % 2 == 0 else -0.3 for i in range(RATE)]) == []


def test_cap_truncates(spark):
    s = _segments(spark, _quiet(RATE // 2) + _tone(440, RATE * 3, 0.3), max_utterance_ms=2000)
    assert s[0].truncated and s[0].end_sample - s[0].start_sample <= RATE * 5 // 2


def test_pause_keeps_both_halves(spark):
    pcm = _quiet(8000) + _tone(440, 8000, 0.3) + _quiet(RATE) + _tone(440, 8000, 0.3) + _quiet(8000)
    s = _segments(spark, pcm)
    assert len(s) == 2 and sum(x.end_sample - x.start_sample for x in s) >= RATE * 9 // 10


def test_levels_and_conditioning(spark):
    df = spark.createDataFrame([("c", [1.0, -1.0, 1.0, -1.0])], "clip_id string, pcm array<float>")
    r = df.select(fr.rms(F.col("pcm")).alias("r"), fr.zero_crossing_rate(F.col("pcm")).alias("z"),
                  fr.mono(F.col("pcm"), F.lit(2)).alias("m"),
                  fr.resample(F.col("pcm"), F.lit(2), F.lit(1)).alias("s")).first()
    assert (r.r, r.z, r.m, r.s) == (1.0, 1.0, [0.0, 0.0], [1.0, 1.0])
