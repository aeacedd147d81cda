"""Rendezvous hashing of stable record keys over weighted shards.

Each key gives every shard a score that only the key, the shard and the shard's weight
decide; the best score wins. A new shard changes no other score, so a record either stays
or moves into the new shard. Only DataFrame functions are used.

Defined results: a null key counts as the empty key; rows with one key share a shard, each
with a slot of its own; null text has no bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: leading hex digits of the order key that cut a shard into parts numbered on their own
PART_DIGITS = 3
_UNIT = float(1 << 52)


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, 13)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(_UNIT)
    return -F.log(unit) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """The winning shard of each key and its score (smaller is better, ties to the smaller shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"))
                       for i, w in enumerate(weights)])
    best = F.array_min(F.transform(
        shards, lambda s: F.struct(_score(key, s["i"], s["w"]).alias("score"), s["i"].alias("i"))))
    return best["i"], best["score"]


def assign(df: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard after one more of ``new_weight`` is added."""
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    shard, score = rendezvous(F.col("_key"), weights)
    fresh = _score(F.col("_key"), F.lit(len(weights)), F.lit(float(new_weight)))
    return (df.withColumn("_key", named)
            .withColumn("_best", F.struct(shard.alias("i"), score.alias("score")))
            .withColumn("shard", F.col("_best.i"))
            .withColumn("grown_shard",
                        F.when(fresh < F.col("_best.score"), len(weights)).otherwise(F.col("shard")))
            .drop("_key", "_best"))


def number_slots(df: DataFrame, order: Column) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, by ``order``, a column of hex digits.

    A shard is a fortieth of everything, so it isn't numbered in one task: its parts (equal
    leading digits) are counted, the counts summed, and each part numbered on its own.
    """
    parts = df.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    before = (parts.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part"))
                          - F.col("_n")).drop("_n"))
    others = [c for c in df.columns if c != "shard"]
    inside = Window.partitionBy("shard", "_part").orderBy("_order", *others)
    return (parts.withColumn("_nth", F.row_number().over(inside))
            .join(before, ["shard", "_part"])
            .withColumn("slot", F.col("_before") + F.col("_nth") - 1)
            .select(*df.columns, "slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents by shard of equal weight, with sizes, checksums and slots."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # the texts are read once; counting and numbering read the narrow table
    placed = keep(assign(narrow, "doc_id", [1.0] * shards))
    order = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "text_crc32", "size"))
    return number_slots(placed, order).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
