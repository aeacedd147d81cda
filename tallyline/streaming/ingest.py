"""Streaming ingest of device batches: validate, merge, tombstone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.records import apply_voids, invalid_reason, upsert
from tallyline.session import shared_dir

ARRIVAL = T.StructType().add("batch", T.IntegerType()).add("place", T.LongType())


def validate_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejected ones as ``(id, reason)``."""
    checked = df.withColumn("_reason", invalid_reason())
    return (
        checked.where("_reason IS NULL").drop("_reason"),
        checked.where("_reason IS NOT NULL").select("id", F.col("_reason").alias("reason")),
    )


def _drain(stream: DataFrame, batch, checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_ingest(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Drain a stream of records into append-only accepted and rejected logs.

    Every micro-batch writes to its own folder, named by the batch id and
    replaced on a repeat, so a replay after a lost executor or driver changes
    nothing. Accepted rows carry ``arrival``, the batch and the place in it. The
    merge happens on read (``current_records``) or in ``compact``.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        arrival = F.struct(F.lit(batch_id).alias("batch"), F.monotonically_increasing_id().alias("place"))
        df = df.withColumn("arrival", arrival).persist()
        try:
            ok, bad = validate_split(df)
            ok.write.mode("overwrite").parquet(f"{root}/accepted/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
        finally:
            df.unpersist()

    _drain(stream, batch, checkpoint)


# --- re-sent rows ------------------------------------------------------------


def content(df: DataFrame) -> Column:
    """Digest of all columns of a row: a record sent again unchanged has the same, an edited one not."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return F.sha2(row, 256)


def run_bounded_ingest(stream: DataFrame, root: str, checkpoint: str, delay: str,
                       event_time: str = "captured_at", key: str = "id") -> None:
    """``run_ingest`` without rows sent again unchanged, with state bounded by event time.

    Devices send at least once. A row equal to one seen is dropped as long as both are less
    than ``delay`` apart in event time; older state is evicted. Rows older than the watermark
    (the latest event time of earlier micro-batches less ``delay``) don't enter the log:
    ``late_rows`` tells them apart. An edited record differs in content and always passes.
    """
    marked = stream.withColumn("_content", content(stream))
    fresh = marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key, "_content"])
    run_ingest(fresh.drop("_content"), root, checkpoint)


def late_rows(arrived: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str = "id") -> DataFrame:
    """Distinct rows of ``arrived`` that no log of a bounded ingest holds: they came too late.

    ``accepted`` decides by content, ``rejected`` by key.
    """
    logged = accepted.select(*arrived.columns)
    seen = logged.select(F.col(key), content(logged).alias("_content")).distinct()
    return (arrived.withColumn("_content", content(arrived))
            .join(seen, [key, "_content"], "left_anti")
            .join(rejected.select(key).distinct(), key, "left_anti")
            .dropDuplicates([key, "_content"]).select(*arrived.columns))


# --- records rejected while their push is under way ----------------------------


def in_flight(acks: DataFrame, edits: DataFrame, longest: str = "1 hour") -> DataFrame:
    """Acknowledged records that were rejected locally between sending and acknowledgement.

    A join of two streams: ``acks`` (``id``, ``sent_at``, ``acked_at``) and ``edits``
    (``id``, ``status``, ``edited_at``). A push takes no more than ``longest``, so an
    acknowledgement meets edits of that span only and either side forgets its older rows. Gives
    ``id``, ``edited_at`` and ``acked_at``; an id appears once per such edit and acknowledgement.
    """
    a = acks.select(F.col("id").alias("_id"), "sent_at", "acked_at").withWatermark("acked_at", longest)
    e = edits.where("status = 'rejected'").select("id", "edited_at").withWatermark("edited_at", longest)
    span = F.expr(f"INTERVAL {longest}")
    return e.join(a, (F.col("id") == F.col("_id")) & (F.col("edited_at") >= F.col("sent_at"))
                  & (F.col("edited_at") <= F.col("acked_at"))
                  & (F.col("edited_at") >= F.col("acked_at") - span)).select("id", "edited_at", "acked_at")


def run_in_flight(acks: DataFrame, edits: DataFrame, root: str, checkpoint: str, longest: str = "1 hour") -> None:
    """Write the voids of diverged records to ``root/voids``, in the micro-batch that finds them.

    A replayed micro-batch replaces its folder. ``current_records`` takes the voids as they are.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        df.groupBy("id").agg(F.min("edited_at").alias("edited_at"), F.min("acked_at").alias("acked_at")).write.mode(
            "overwrite").parquet(f"{root}/voids/batch={batch_id}")

    _drain(in_flight(acks, edits, longest), batch, checkpoint)


VOIDS = "id string, edited_at timestamp, acked_at timestamp, batch int"


def read_voids(spark: SparkSession, root: str) -> DataFrame:
    """Voids found so far with the micro-batch that found them."""
    return spark.read.schema(VOIDS).parquet(f"{root}/voids")


def current_records(accepted: DataFrame, voids: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Of every record that is not tombstoned the row that arrived last from its owner.

    ``base`` holds records merged before (``compact``); ``accepted`` came after it.
    """
    return apply_voids(upsert(accepted.limit(0) if base is None else base, accepted, "arrival"), voids)


def compact(accepted: DataFrame, base: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Merge an accepted log into the records of the capture dates it touches.

    Touched are the dates of the log's rows and those on which the base holds one of its records:
    who owns a record is decided by all its rows. The other dates are left as they are. The
    merged dates go to ``path``; the caller replaces them and drops the log.
    """
    dated = base.withColumn("capture_date", F.to_date("captured_at"))
    dates = accepted.select(F.to_date("captured_at").alias("capture_date")).unionAll(
        dated.join(accepted.select(key).distinct(), key, "left_semi").select("capture_date")).distinct()
    touched = dated.join(dates, "capture_date", "left_semi").drop("capture_date")
    merged = upsert(touched, accepted, "arrival").withColumn("capture_date", F.to_date("captured_at"))
    merged.write.mode("overwrite").partitionBy("capture_date").parquet(path)
    return accepted.sparkSession.read.schema(base.schema).parquet(path).select(*base.columns)


def read_logs(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of an ingest (with ``arrival``) and its rejected ids."""
    stored = T.StructType(schema.fields + [T.StructField("arrival", ARRIVAL)])
    return (spark.read.schema(stored).parquet(f"{root}/accepted"),
            spark.read.schema("id string, reason string").parquet(f"{root}/rejected"))


def ingest_once(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drain a stream into a new folder and return its accepted and rejected logs."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    run_ingest(stream, root, f"{root}/checkpoint")
    return read_logs(spark, root, stream.schema)
