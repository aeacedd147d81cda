"""Questions asked of the merged record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.ordered import lagged, last_n, trailing, upper_median


def counts_by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def counts_rollup(df: DataFrame) -> DataFrame:
    return df.rollup("device_id", "status").agg(F.count("*").alias("n"))


def last_active(df: DataFrame) -> DataFrame:
    """Most recent draft or confirmed record per device."""
    return df.where(F.col("status").isin("draft", "confirmed")).groupBy("device_id").agg(
        F.max("id").alias("last_id"))


def stock_by_location(df: DataFrame) -> DataFrame:
    """Latest confirmed or synced count per location and part.

    The latest record is an aggregate, so a much counted shelf is combined on
    the map side instead of being sorted in one task.
    """
    live = df.where(F.col("status").isin("confirmed", "synced")
                    & F.col("location_id").isNotNull() & F.col("part_number").isNotNull())
    latest = live.groupBy("location_id", "part_number").agg(
        F.max_by("quantity", "id").alias("quantity"))
    return latest.groupBy("location_id").agg(
        F.sum("quantity").alias("quantity"), F.count("*").alias("parts"))


def review_reason_histogram(df: DataFrame) -> DataFrame:
    return df.select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n"))


def correction_rates(log: DataFrame, records: DataFrame, tasks: int | None = None) -> DataFrame:
    """Corrections per field and operator, with totals, against captured records.

    ``tasks`` is the number the log is dealt to by record, for a log whose size the caller knows.
    """
    who = records.select(F.col("id").alias("observation_id"), "operator_id")
    if tasks:
        log, who = log.repartition(tasks, "observation_id"), who.repartition(tasks, "observation_id")
    log = log.groupBy("observation_id", "field").agg(F.count("*").alias("corrections"))
    captured = records.cube("operator_id").agg(F.count("*").alias("captured")).select(
        F.col("operator_id").alias("_op"), "captured")
    # a record has one operator: after one row per record and field, all but the
    # totals over fields are plain sums, and those need one row per record
    each = log.join(who, "observation_id").groupBy("operator_id", "observation_id", "field").agg(
        F.sum("corrections").alias("corrections"))
    by_field = each.groupBy("operator_id", "field").agg(
        F.sum("corrections").alias("corrections"), F.count("*").alias("records"))
    by_operator = each.groupBy("operator_id", "observation_id").agg(
        F.sum("corrections").alias("corrections")).groupBy("operator_id").agg(
        F.sum("corrections").alias("corrections"), F.count("*").alias("records"))
    sums = [F.sum("corrections").alias("corrections"), F.sum("records").alias("records")]
    none = F.lit(None).cast("string")
    shape = ["operator_id", "field", "corrections", "records"]
    fixes = by_field.select(shape)
    for part in (by_field.groupBy("field").agg(*sums).withColumn("operator_id", none),
                 by_operator.withColumn("field", none),
                 by_operator.agg(*sums).where("records > 0").withColumns(
                     {"operator_id": none, "field": none})):
        fixes = fixes.unionAll(part.select(shape))
    return fixes.join(captured, F.col("operator_id").eqNullSafe(F.col("_op"))).select(
        "operator_id", "field", "corrections", "records",
        (F.col("records") / F.col("captured")).alias("rate"))


def accuracy(df: DataFrame, truth: DataFrame, key: str = "item_key") -> DataFrame:
    """Share of non-rejected records whose quantity and location are both right."""
    graded = df.where("status != 'rejected'").join(truth, key)
    right = (F.col("quantity").eqNullSafe(F.col("true_quantity"))
             & F.col("location_id").eqNullSafe(F.col("true_location_id")))
    return graded.agg(F.count("*").alias("captured"),
                      F.sum(right.cast("bigint")).alias("correct"),
                      F.avg(right.cast("double")).alias("accuracy"))


def latency_stats(df: DataFrame, key: str, order: str, latency: str) -> DataFrame:
    """Utterances, last latency and upper median of the last 50, per device."""
    window = last_n(df, [key], order, latency, 50, "_last")
    return window.select(
        key, F.size("_last").cast("bigint").alias("utterances"),
        F.element_at("_last", -1).alias("last_latency"),
        upper_median(F.array_sort("_last")).alias("median_latency"))


def latency_alerts(df: DataFrame, key: str, order: str, latency: str, target: Column) -> DataFrame:
    """First capture at which the median of the last 50 passes the target.

    At least three latencies are needed; every device alerts once.
    """
    rolled = trailing(df, [key], order, latency, 50, "_last")
    breach = rolled.where((F.size("_last") >= 3) & (upper_median(F.col("_last")) > target))
    return breach.groupBy(key).agg(F.min(order).alias("first_alert"))


def time_per_item(df: DataFrame) -> DataFrame:
    """Seconds since the device's previous capture."""
    out = lagged(df, ["device_id"], "id", "captured_at", "previous_at")
    return out.withColumn("gap_seconds", (
        F.unix_micros("captured_at") - F.unix_micros("previous_at")) / 1e6)


def push_report(df: DataFrame, accepted: DataFrame, refused: DataFrame, voids: DataFrame,
                size: int = 50) -> DataFrame:
    """Pushed, batches, rejected and voided per device."""
    flags = (
        df.select("id", "device_id", "status")
        .join(accepted.select("id").distinct().withColumn("_a", F.lit(1)), "id", "left")
        .join(refused.select("id").distinct().withColumn("_r", F.lit(1)), "id", "left")
        .join(voids.select("id").distinct().withColumn("_v", F.lit(1)), "id", "left")
    )
    counts = flags.groupBy("device_id").agg(
        F.count(F.when(F.col("status") == "confirmed", 1)).alias("queued"),
        F.count(F.when((F.col("status") == "confirmed") & F.col("_a").isNotNull(), 1)).alias("pushed"),
        F.count("_r").alias("rejected"), F.count("_v").alias("voided"))
    return counts.select(
        "device_id", "pushed", F.ceil(F.col("queued") / size).cast("bigint").alias("batches"),
        "rejected", "voided")


def snapshot_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of a dimension snapshot."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest"))


def refresh_report(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """For every dimension whether a pull would change it: ``modified`` or ``not_modified``."""
    out = None
    for name, df in new.items():
        a = snapshot_digest(old[name]).select(F.col("n").alias("old_n"), F.col("digest").alias("old_digest"))
        one = snapshot_digest(df).join(a).select(
            F.lit(name).alias("dimension"), "n",
            F.when((F.col("n") == F.col("old_n")) & (F.col("digest") == F.col("old_digest")), "not_modified")
            .otherwise("modified").alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


def pull_report(locations: DataFrame, parts: DataFrame, units: DataFrame) -> DataFrame:
    """Row counts and digests of the three dimensions, one row each."""
    out = None
    for name, df in (("locations", locations), ("parts", parts), ("units", units)):
        one = snapshot_digest(df).withColumn("dimension", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def shift_summary(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Captures per device and work session (an addition of this library)."""
    return df.groupBy("device_id", F.session_window("captured_at", gap).alias("w")).agg(
        F.count("*").alias("n")).select(
        "device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
