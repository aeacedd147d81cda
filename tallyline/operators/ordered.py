"""Ordered per-key computations that survive a key holding most of the rows.

A plain ``row_number`` over a device sorts all rows of that device in one task.
Here rows are range-partitioned by key and order, so a large key spans as many
partitions as it needs, sorted and written once. What a partition hands to the next one
is a single row per key: its count and its last value. Only these summaries are accumulated
over a key; the rows themselves are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import cut_lineage


def _placed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows in order: ``_part``, and ``_id`` that counts up within it.

    Written before use, since the borders are sampled: every reader sees the same ones, and
    a lost executor costs a re-read.
    """
    dealt = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    return cut_lineage(dealt.withColumn("_id", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_id", 33))


def _carried(placed: DataFrame, keys: list[str], *more: Column) -> tuple[DataFrame, Window]:
    """One row per key and partition with its size and first row, and the order to scan them in."""
    held = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), *more)
    return held, Window.partitionBy(*keys).orderBy("_part")


def _attach(placed: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    c = carried.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_part": "_k_part"})
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(c, same).drop("_k_part", *[f"_k_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "rn") -> DataFrame:
    """Add the 1-based position of a row within its key."""
    placed = _placed(df, keys, order)
    held, along = _carried(placed, keys)
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = held.select(*keys, "_part", (before - F.col("_first") + 1).alias("_shift"))
    return (_attach(placed, shift, keys).withColumn(out, (F.col("_id") + F.col("_shift")).cast("bigint"))
            .drop("_id", "_part", "_shift"))


def lagged(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add the value of the previous row within the key."""
    placed = _placed(df, keys, order)
    held, along = _carried(placed, keys, F.max_by(value, "_id").alias("_tail"))
    heads = held.select(*keys, "_part", "_first", F.lag("_tail").over(along).alias("_prev"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_id")
    return (
        _attach(placed.withColumn("_in", F.lag(value).over(inside)), heads, keys)
        .withColumn(out, F.when(F.col("_id") == F.col("_first"), F.col("_prev")).otherwise(F.col("_in")))
        .drop("_id", "_part", "_first", "_prev", "_in")
    )


def trailing(df: DataFrame, keys: list[str], order: str, value: str, size: int,
             out: str, bucket: int = 10_000) -> DataFrame:
    """Add the sorted values of the last ``size`` rows up to each row.

    Rows are numbered, cut into buckets of ``bucket`` rows, and the last
    ``size - 1`` rows of a bucket also travel with the next one.
    """
    n = numbered(df, keys, order, "_pos")
    home = F.floor((F.col("_pos") - 1) / bucket)
    tail = (F.col("_pos") - 1) % bucket >= bucket - (size - 1)
    spread = n.withColumn("_home", home).withColumn("_bucket", F.explode(F.when(
        tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_pos").rowsBetween(-(size - 1), 0)
    return (
        spread.withColumn(out, F.array_sort(F.collect_list(value).over(w)))
        .where("_bucket = _home").drop("_home", "_bucket", "_pos")
    )


def last_n(df: DataFrame, keys: list[str], order: str, value: str, n: int, out: str,
           salts: int = 64) -> DataFrame:
    """Per key the last ``n`` values, oldest first, in two bounded steps."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))

    def top(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(order))
        return frame.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)

    some = top(top(salted, [*keys, "_salt"]).drop("_rn"), keys)
    return some.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        order, F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def upper_median(sorted_values: Column) -> Column:
    """The element at n/2 (rounded down) of a sorted array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))
