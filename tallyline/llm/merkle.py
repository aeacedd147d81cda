"""Merkle manifest of a dataset: sibling-shift self-joins, level by level.

Each row is a leaf; leaves of one source make a tree, the trees' roots make one more. On every
level nodes meet their siblings by an equi-join on computed indices (the index XOR one for
binary trees, the slot shifted by 1 to ``arity - 1`` otherwise); rows of slot zero emit parents.
Going down again, a node's path is its siblings and then its parent's path, so each leaf ends
with the proof that leads to the root.

Places of leaves are not numbered in one task a source: rows are sorted over range partitions,
and a partition's share of each source is shifted by what earlier partitions hold. Nodes are dealt by
(tree, run), which holds siblings together: one exchange serves the join, the grouping of siblings
and the join with the parents' paths. Every level is written to the shared folder.

Defined results: a null is ``-`` in a leaf; rows with equal doc_id are ordered by their digest, so
repeated rows have neighbouring leaves; null doc_ids come first and are never tampered with; a null
source is a tree of its own; a lone leaf is its source's root and a lone source's root the root;
without siblings the proof is the digest of nothing; an empty table gives an empty result; columns
outside the manifest are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: where this divides a doc_id's checksum the text is tampered with
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value that no other sequence of values can spell: its bytes, ``:`` and itself; ``-`` if null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def leaf(fields: Sequence[str] = FIELDS, **instead: Column) -> Column:
    return digest(*[encoded(instead.get(f, F.col(f))) for f in fields])


# ---------------------------------------------------------------- places


def numbered(rows: DataFrame, tree: str, order: Sequence[str | Column]) -> DataFrame:
    """Add ``i``, the place in the tree from 0, and ``n``, the size of the tree.

    Only a partition's totals per tree are summed, never the rows of a tree in one task.
    """
    dealt = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    placed = keep(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    held = placed.groupBy(tree, part).agg(F.count("*").alias("_held"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = held.select(
        tree, "_part", "_first", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(tree)).alias("n"))
    return (placed.withColumn("_part", part).join(shares, [tree, "_part"])
            .withColumn("i", F.col("_id") - F.col("_first") + F.col("_before"))
            .select(*rows.columns, "i", "n"))


# ---------------------------------------------------------------- levels


@contextmanager
def _together(spark: SparkSession) -> Iterator[None]:
    """Joins may use a partitioning on part of their keys, as long as something is written here."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _dealt(nodes: DataFrame, arity: int) -> DataFrame:
    run = F.expr(f"i div {arity}")
    return (nodes.withColumn("run", run).withColumn("slot", (F.col("i") % arity).cast("int"))
            .repartition("tree", "run"))


def _siblings(asking: DataFrame, dealt: DataFrame, arity: int) -> DataFrame:
    """Rows of ``asking`` with ``left`` and ``right``, the digests before and after theirs in the run."""
    if arity == 2:
        asked = asking.withColumn("want", F.col("slot").bitwiseXOR(F.lit(1)))
    else:
        shift = F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))
        asked = asking.withColumn("shift", shift).withColumn(
            "want", ((F.col("slot") + F.col("shift")) % arity).cast("int")).drop("shift")
    kin = dealt.select("tree", "run", F.col("slot").alias("want"), F.col("h").alias("kin"))
    found = F.when(F.col("kin").isNotNull(), F.struct("want", "kin"))
    ordered = F.sort_array(F.collect_list(found))

    def joined(before: bool) -> Column:
        some = F.filter("kin", lambda s: s["want"] < F.col("slot") if before else s["want"] > F.col("slot"))
        return F.array_join(F.transform(some, lambda s: s["kin"]), "")

    return (asked.join(kin, ["tree", "run", "want"], "left").groupBy(*asking.columns).agg(ordered.alias("kin"))
            .select(*asking.columns, joined(True).alias("left"), joined(False).alias("right")))


def build(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Levels from the leaves (``tree``, ``i``, ``n``, ``h``; more columns may follow) up.

    A level holds the nodes of the trees that still had several one level below; ``n`` is the
    number of a tree's nodes on the level.
    """
    if arity < 2:
        raise ValueError("a parent needs two children")
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        dealt = _dealt(levels[-1].where("n > 1").select("tree", "i", "n", "h"), arity)
        parents = _siblings(dealt.where("slot = 0"), dealt, arity).select(
            "tree", F.col("run").alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
            digest(F.col("h"), F.col("right")).alias("h"))
        with _together(leaves.sparkSession):
            levels.append(keep(parents))
        most = -(-most // arity)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """``tree`` and the digest ``h`` it ends with."""
    ends = [level.where("n = 1").select("tree", "h") for level in levels]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionAll(more)
    return out


def proofs(levels: Sequence[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaves with ``path``, the pairs (left, right) of sibling digests from their run to the top.

    ``above`` has for each tree the ``path`` that goes on from its root, and columns to hand down.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        done = level.where("n = 1").join(above, "tree").select(*level.columns, "path", *more)
        if below is None:
            now = done
        else:
            dealt = _dealt(level.where("n > 1"), arity)
            kin = F.struct("left", "right")
            up = below.select("tree", F.col("i").alias("run"), "path", *more)
            now = done.unionByName(_siblings(dealt, dealt, arity).join(up, ["tree", "run"]).select(
                *level.columns, F.concat(F.array(kin), F.col("path")).alias("path"), *more))
        below = now
        if k:
            with _together(level.sparkSession):
                below = keep(now)
    return below


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


# ---------------------------------------------------------------- documents


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Documents as leaves with the proof of each: ``doc_id``, ``tree``, ``i``, ``h``, ``tampered``,
    ``path``, ``subroot`` and ``root``. ``tampered`` is the leaf of the altered text, if altered."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    low = F.translate("text", _UPPER, _LOWER)
    leaves = keep(docs.select(
        "doc_id", "source", encoded(F.col("source")).alias("tree"), leaf().alias("h"),
        F.when(altered, leaf(text=low)).alias("tampered")))
    levels = build(keep(numbered(leaves.drop("source"), "tree", ["doc_id", "h", "tampered"])), arity)
    # sources in their own order; one row each
    named = leaves.groupBy("tree", "source").agg(F.lit(0).alias("top"))
    tops = named.join(roots(levels), "tree").select(F.lit("").alias("one"), "tree", "source", "h")
    places = numbered(tops.withColumnRenamed("tree", "name"), "one", [F.col("source").asc_nulls_first()])
    crown = build(keep(places.select(F.col("one").alias("tree"), "i", "n", "h", "name")), arity)
    peak = roots(crown).select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                               F.col("h").alias("root"))
    with _together(docs.sparkSession):
        above = keep(proofs(crown, peak, arity).select(
            F.col("name").alias("tree"), "path", F.col("h").alias("subroot"), "root"))
    return proofs(levels, above, arity)


def prove_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Each document's leaf, roots and proof, and what its leaf, tampered or not, folds to."""
    proven = manifest(docs, arity).select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("tampered", "h")).alias("folded_root"))
    with _together(docs.sparkSession):
        proven = keep(proven)
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
