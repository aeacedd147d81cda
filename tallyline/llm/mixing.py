"""Mix sources to target weights with exact quotas of permuted blocks.

Each source is cut into blocks by a hash of its rows. Its target gives whole passes over
all blocks and a last pass that stops inside one block, so the words it gives are exact. A
splitting tree over the output shards divides the block quotas: a node's left half draws
its share of every source's blocks from the multivariate hypergeometric distribution, the
right half keeps the rest, until each leaf is one shard. A source's permuted blocks are
dealt to the shards in that order, so draws are disjoint, and rows are shuffled by a keyed
hash within their shard.

Only totals per source (not per row or block) come to the driver. Defined results: null
text has size 0, a null source is a source of its own and comes last, rows that repeat are
separate rows, an empty table gives an empty mix; reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

BLOCKS = 1024
SHARDS = 16


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float,
                 cap: float = 2.0) -> list[float]:
    """Share ``total`` by weight; none above ``cap`` times its size, the excess reshared."""
    target, rest = [0.0] * len(sizes), float(total)
    free = [i for i in range(len(sizes))]
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in free:
                target[i] = rest * weights[i] / weight
            break
        for i in full:
            target[i] = cap * sizes[i]
        rest -= sum(target[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return target


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of every source (columns) for every shard (rows); columns sum to the quotas.

    Shards get equal block counts, at most one apart. Each node draws from its own stream,
    so a subtree comes out the same however the others are walked.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    work = [(0, shards, np.asarray(quotas, np.int64))]
    while work:
        lo, hi, left = work.pop()
        if hi - lo == 1:
            out[lo] = left
            continue
        mid, total = (lo + hi) // 2, int(left.sum())
        share = total * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | hi]))
        drawn, rest, open_ = np.zeros_like(left), share, total
        for i, n in enumerate(left):
            open_ -= int(n)
            # numpy's sampler takes counts below 1e9; blocks per source are far fewer
            drawn[i] = rng.hypergeometric(int(n), open_, rest) if n and rest and open_ else min(int(n), rest)
            rest -= int(drawn[i])
        work += [(lo, mid, drawn), (mid, hi, left - drawn)]
    return out


class Mix:
    """A plan of a mix: ``rows`` has one row per input row, ``sources`` one per source."""

    def __init__(self, docs: DataFrame, size: Column, weights: Sequence[float] = (5.0, 2.0, 1.0),
                 share: float = 1.5, cap: float = 2.0, shards: int = SHARDS, seed: int = 11,
                 id_column: str = "doc_id", source_column: str = "source"):
        spark = docs.sparkSession
        self.shards, self.seed = shards, seed
        key = self.key(id_column)
        # the texts are read once; everything below reads these few columns
        self.rows = keep(docs.select(
            F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
            F.monotonically_increasing_id().alias("row_id"), size.alias("size"), key.alias("key"))
            .withColumn("block", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % BLOCKS)))
        totals = (self.rows.groupBy("source").agg(F.sum("size").alias("n")).collect())
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [int(r["n"]) for r in totals]
        weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
        target = fill_targets(sizes, weight, share * sum(sizes), cap)
        whole = [int(t // n) if n else 0 for t, n in zip(target, sizes)]
        rest = [round(t) - w * n for t, w, n in zip(target, whole, sizes)]
        self.sources = spark.createDataFrame(
            [(r["source"], n, t, w, k) for r, n, t, w, k in zip(totals, sizes, target, whole, rest)],
            "source string, source_size long, target double, passes int, rest long")

    def key(self, id_column: str = "doc_id") -> Column:
        """A hash of a row's id and text, which orders and joins rows."""
        return F.md5(F.concat_ws("/", F.coalesce(F.col(id_column).cast("string"), F.lit("")),
                                 F.xxhash64("text").cast("string"), F.lit(str(self.seed))))

    def blocks(self) -> DataFrame:
        """Blocks in permuted order: rank, words before the block, and what the last pass takes."""
        order = Window.partitionBy("source").orderBy("shuffled")
        sums = (self.rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
                .withColumn("shuffled", F.md5(F.concat_ws("/", "source", "block", F.lit(str(self.seed)))))
                .withColumn("rank", F.row_number().over(order) - 1)
                .withColumn("before", F.sum("words").over(order) - F.col("words")).drop("shuffled"))
        return (sums.join(self.sources, sums["source"].eqNullSafe(self.sources["source"]))
                .drop(self.sources["source"]))

    def taken(self) -> DataFrame:
        """Every input row with ``last``, the words the last pass takes of it, and ``taken``."""
        blocks = self.blocks()
        part = (F.col("rest") - F.col("before")).alias("part")
        joined = (self.rows.alias("r").join(
            blocks.select("source", "block", "rank", "words", "passes", "source_size", "target", part).alias("b"),
            F.expr("r.source <=> b.source and r.block = b.block"))
            .select("r.*", "rank", "words", "passes", "source_size", "target", "part"))
        # one block of a source is cut; there rows come by key until its part is used up
        order = Window.partitionBy("source", "block").orderBy("key", "row_id")
        cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
        ran = F.sum("size").over(order) - F.col("size")
        inside = (joined.where(cut).withColumn("last", F.greatest(
            F.lit(0).cast("long"), F.least(F.col("size"), F.col("part") - ran))))
        whole = joined.where(~cut).withColumn(
            "last", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
        return (whole.unionByName(inside)
                .withColumn("taken", F.col("passes") * F.col("size") + F.col("last")))

    def placed(self) -> DataFrame:
        """One row per copy the mix takes: row, pass, words, shard and its place by ``at``."""
        spark = self.rows.sparkSession
        per = (self.blocks().groupBy("source").agg(
            F.count("*").alias("blocks"), F.max("passes").alias("passes"),
            F.sum((F.col("rest") > F.col("before")).cast("long")).alias("more")))
        names = per.collect()  # one row per source
        names.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        quotas = [r["blocks"] * r["passes"] + r["more"] for r in names]
        ends = np.cumsum(split_quotas(quotas, self.shards, self.seed), axis=0)
        bounds = spark.createDataFrame(
            [(r["source"], r["blocks"], [int(x) for x in ends[:, i]]) for i, r in enumerate(names)],
            "source string, n_blocks long, ends array<long>")
        copies = (self.taken()
                  .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
                  .withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size"))
                              .otherwise(F.col("last")))
                  .where((F.col("copy") < F.col("passes")) | (F.col("last") > 0)))
        draw = F.col("copy") * F.col("n_blocks") + F.col("rank")
        return (copies.alias("c").join(bounds.alias("q"), F.expr("c.source <=> q.source"))
                .withColumn("shard", F.size(F.filter("ends", lambda e: e <= draw)))
                .withColumn("at", F.md5(F.concat_ws("/", "key", "copy", F.lit(str(self.seed)))))
                .select("c.row_id", "c.doc_id", "c.source", "c.key", "copy", "c.size", "words", "shard", "at"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Words taken of every document at the production weights: what the shards' draws hold of it."""
    plan = Mix(docs, word_count())
    drawn = plan.placed().groupBy("row_id").agg(F.sum("words").alias("drawn"))
    known = plan.rows.join(plan.sources.withColumnRenamed("source", "named"), F.expr("source <=> named"))
    return known.join(drawn, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("drawn", F.lit(0)).cast("long").alias("taken"))


def first_words(text: str, count: int) -> str:
    """The leading words of a text, cut behind the last of them."""
    end = 0
    for i, m in enumerate(re.finditer(WORD, text)):
        if i == count:
            break
        end = m.end()
    return text[:end]


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: every copy as a row of ``docs``' columns, by shard and shuffled place.

    The document at which a source's last pass ends is cut. Rows equal in id and text take
    their other columns from one of them.
    """
    plan = Mix(docs, word_count(), shards=shards)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    texts = docs.select(row.alias("row"), plan.key().alias("key")).dropDuplicates(["key"])
    full = plan.placed().select("key", "size", "words", "shard", "at").join(texts, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [first_words(t, n) for t, n in zip(*(batch.column(i).to_pylist() for i in (0, 1)))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *batch.columns[1:]], batch.schema.names)

    # at most one document of each source is cut
    part = full.where("words < size").select(F.col("row.text").alias("text"), "words", "shard", "at", "row")
    part = part.mapInArrow(cut, part.schema)
    whole = full.where("words = size").select(F.col("row.text").alias("text"), "words", "shard", "at", "row")
    both = whole.unionAll(part)
    return (both.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
            .select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]))
