"""Merges into a base bucketed by record id."""

import random
import uuid

from tallyline import sources
from tallyline.operators.records import upsert, upsert_bucketed

COLS = "id string, device_id string, status string, arrival long"


def _stored(spark, tmp_path, rows):
    name = f"base_{uuid.uuid4().hex}"
    return sources.write_bucketed(spark.createDataFrame(rows, COLS), name, str(tmp_path / name))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_merge_equals_the_shuffled_one(spark, tmp_path):
    rng = random.Random(11)
    base = [(f"r{i}", f"d{i % 3}" if i % 9 else None, "draft", 0) for i in range(200)]
    batch = [(f"r{rng.randrange(260)}", rng.choice(["d0", "d1", "d2", None]), rng.choice("abc"), n + 1) for n in range(900)]
    sent = spark.createDataFrame(batch, COLS)
    got = _rows(upsert_bucketed(_stored(spark, tmp_path, base), sent, "arrival"))
    assert got == _rows(upsert(spark.createDataFrame(base, COLS), sent, "arrival"))
    assert len(got) == len({r[0] for r in base} | {r[0] for r in batch})


def test_the_owner_stays_across_dates_and_empty_sides(spark, tmp_path):
    stored = _stored(spark, tmp_path, [("x", "dev1", "draft", 0)])
    intruder = spark.createDataFrame([("x", "intruder", "synced", 5)], COLS)
    assert _rows(upsert_bucketed(stored, intruder, "arrival")) == [("x", "dev1", "draft", 0)]
    assert _rows(upsert_bucketed(stored, intruder.limit(0), "arrival")) == [("x", "dev1", "draft", 0)]
    empty = _stored(spark, tmp_path, [])
    assert _rows(upsert_bucketed(empty, intruder, "arrival")) == [("x", "intruder", "synced", 5)]


def test_the_base_is_not_shuffled(spark, tmp_path):
    stored = _stored(spark, tmp_path, [(f"r{i}", "d", "draft", 0) for i in range(50)])
    batch = spark.createDataFrame([("r1", "d", "synced", 1)], COLS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = upsert_bucketed(stored, batch, "arrival")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # both exchanges are of the batch: by key and device, then by key
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2
