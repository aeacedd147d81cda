"""Bounded ingest, in-flight divergence and compaction."""

import datetime as dt

import pytest

from tallyline.operators.records import upsert
from tallyline.streaming import ingest

DAY = dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc)
SCHEMA = ("id string, device_id string, captured_at timestamp, language string, status string, schema_version int, "
          "parsed struct<quantity:double,item_text:string>, "
          "confidence struct<asr:double,quantity:double,location:double,item:double>")


def record(n, days, item="nails", device="d1", status="draft"):
    return (f"0196a0c0-0000-7000-8000-{n:012x}", device, DAY + dt.timedelta(days=days), "en", status, 1, (1.0, item),
            (1.0, 1.0, 1.0, 1.0))


def as_set(df):
    return sorted((r.id[-2:], r.parsed.item_text, r.device_id) for r in df.collect())


@pytest.fixture
def pushes(spark, tmp_path):
    """Three pushes: an edit and a row sent again in the second, a late row and an early repeat in the third."""
    parts = [
        [record(1, 0), record(2, 0), record(2, 0), record(3, 0, status="gone")],
        [record(4, 9), record(1, 0, "screws"), record(2, 0)],
        [record(5, 1), record(4, 9), record(6, 9)],
    ]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"inbox/push-{n}"))
        ingest.run_bounded_ingest(
            spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(tmp_path / "inbox/*")),
            str(tmp_path), str(tmp_path / "checkpoint"), "3 days")
    arrived = spark.read.schema(SCHEMA).parquet(str(tmp_path / "inbox/*"))
    return arrived, *ingest.read_logs(spark, str(tmp_path), arrived.schema)


def test_bounded_ingest(pushes):
    arrived, accepted, rejected = pushes
    assert as_set(accepted) == [("01", "nails", "d1"), ("01", "screws", "d1"), ("02", "nails", "d1"),
                                ("04", "nails", "d1"), ("06", "nails", "d1")]
    assert [r.id[-2:] for r in rejected.collect()] == ["03"]
    assert as_set(ingest.late_rows(arrived, accepted, rejected)) == [("05", "nails", "d1")]


def test_bounded_ingest_and_late_rows_equal_the_batch(spark, pushes):
    arrived, accepted, rejected = pushes
    none = spark.createDataFrame([], "id string")
    got = set(as_set(ingest.current_records(accepted, none))) | set(
        as_set(ingest.late_rows(arrived, accepted, rejected)))
    assert got == {("01", "screws", "d1"), ("02", "nails", "d1"), ("04", "nails", "d1"), ("05", "nails", "d1"),
                   ("06", "nails", "d1")}


def test_a_drained_ingest_changes_nothing(spark, tmp_path, pushes):
    before = as_set(pushes[1])
    ingest.run_bounded_ingest(
        spark.readStream.schema(pushes[0].schema).parquet(str(tmp_path / "inbox/*")),
        str(tmp_path), str(tmp_path / "checkpoint"), "3 days")
    assert as_set(ingest.read_logs(spark, str(tmp_path), pushes[0].schema)[0]) == before


def test_state_is_evicted(spark, tmp_path):
    """After a jump of event time only rows within the delay are remembered."""
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, rows in enumerate(([record(k, 0) for k in range(40)], [record(99, 50)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"inbox/push-{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "inbox/*"))
        marked = stream.withColumn("_content", ingest.content(stream)).withWatermark("captured_at", "1 day")
        query = (marked.dropDuplicatesWithinWatermark(["id", "_content"]).writeStream.format("noop")
                 .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held == 1


ACKS, EDITS = "id string, sent_at timestamp, acked_at timestamp", "id string, status string, edited_at timestamp"


def minutes(n):
    return DAY + dt.timedelta(minutes=n)


def flow(spark, root):
    ingest.run_in_flight(
        spark.readStream.schema(ACKS).parquet(f"{root}/acks/*"), spark.readStream.schema(EDITS).parquet(f"{root}/edits/*"),
        root, f"{root}/checkpoint")
    return sorted((r.id, r.batch) for r in ingest.read_voids(spark, root).collect())


def test_in_flight_rejections_are_voided_with_their_acknowledgement(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("a", "rejected", minutes(10)), ("b", "confirmed", minutes(10)), ("c", "rejected", minutes(40)),
                           ("d", "rejected", minutes(5)), ("e", "rejected", minutes(1))], EDITS).write.parquet(f"{root}/edits/0")
    spark.createDataFrame([("x", minutes(0), minutes(1))], ACKS).write.parquet(f"{root}/acks/0")
    assert flow(spark, root) == []
    spark.createDataFrame([("a", minutes(0), minutes(20)), ("b", minutes(0), minutes(20)), ("c", minutes(0), minutes(20)),
                           ("d", minutes(5), minutes(5)), ("e", minutes(2), minutes(20))], ACKS).write.parquet(f"{root}/acks/1")
    first = flow(spark, root)
    # at both ends of the span counts; before sending, or after the acknowledgement, does not
    assert [i for i, _ in first] == ["a", "d"] and len({b for _, b in first}) == 1
    assert flow(spark, root) == first
    voids = ingest.read_voids(spark, root)
    records = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    assert [r.id for r in records.join(voids.select("id"), "id", "left_anti").collect()] == ["b"]


def test_compaction_keeps_owners_across_dates(spark, tmp_path):
    base = spark.createDataFrame([record(1, 0, "own"), record(2, 5), record(3, 9)], SCHEMA).selectExpr(
        "*", "CAST(NULL AS struct<batch:int,place:bigint>) AS arrival")
    log = spark.createDataFrame([record(1, 1, "stolen", "intruder"), record(3, 9, "new")], SCHEMA).selectExpr(
        "*", "named_struct('batch', 0, 'place', monotonically_increasing_id()) AS arrival")
    merged = ingest.compact(log, base, str(tmp_path / "merged"))
    assert as_set(merged) == [("01", "own", "d1"), ("03", "new", "d1")]
    assert as_set(upsert(base, log, "arrival").where("captured_at <> timestamp'2026-01-15'")) == as_set(merged)
