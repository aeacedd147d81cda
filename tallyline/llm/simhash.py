"""SimHash near-duplicates: deletion-variant signatures of few segments, an equi-join, verification.

Two 64-bit fingerprints at Hamming distance of at most two, cut into two segments, have a
segment that differs by at most one bit. Each segment is indexed under every variant with one
bit taken out as a wildcard: such a pair agrees on a whole variant. Keys are the bits a
variant fixes (``mask`` and ``bits``), so equal keys are exact and nothing rests on a hash.

Only distinct fingerprints are indexed. One aggregate per key counts its fingerprints: a key
of two is a pair, verified where it stands; larger keys fetch their members by an equi-join,
and one task compares the members of a key up to ``CROWD`` and returns a forest of its links,
not the pairs. A key with more is cut again: its segment is settled, so the rest is halved and
indexed in the same manner, where such a pair again agrees on a variant. The third cut
leaves 11 free bits, 2,048 fingerprints at most, so every key ends within ``CROWD``.

Defined results: words are lower-cased in A-Z only; null or wordless text has fingerprint
zero, which links like any other; fewer words than a shingle make one shingle; rows that
repeat share all results; a null doc_id is never a component's smallest unless all are null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, keep
from .components import components

SEED = 42
BITS = 64
#: bits two linked fingerprints may differ in: the scheme of segments holds for two
REACH = 2
#: the largest key one task compares; what the last cut leaves is no larger
CROWD = 2048
#: halves of the segments at each cut
HALVES = (32, 16, 8)
#: words of one text held as a list at once, and shingles whose bits are summed at once
PIECE = 1 << 15
#: keys that rows with one fingerprint are dealt over
DEAL = 64


# ---------------------------------------------------------------- fingerprints


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list of bounded length at a time."""
    while True:
        words = raw.split(None, PIECE)
        if len(words) <= PIECE:
            yield words
            return
        raw = words.pop()
        yield words


def shingles(raw: bytes, size: int) -> Iterator[Iterable[bytes]]:
    """Space-joined word shingles of a text in order, repeats included, some at a time."""
    before: list[bytes] = []
    seen = False
    for words in _pieces(raw.lower()):
        words = before + words
        if len(words) >= size:
            seen = True
            yield map(b" ".join, zip(*(islice(words, k, None) for k in range(size))))
        before = words[-(size - 1):] if size > 1 else []
    if not seen and before:
        yield [b" ".join(before)]


class _Votes:
    """Set bits per text, summed over bounded lots of hashes."""

    def __init__(self, texts: int):
        self.ones = np.zeros((texts, BITS), np.int64)
        self.n = np.zeros(texts, np.int64)
        self._lots: list[np.ndarray] = []
        self._owners: list[np.ndarray] = []
        self._held = 0

    def add(self, text: int, hashes: np.ndarray) -> None:
        self.n[text] += len(hashes)
        self._lots.append(hashes)
        self._owners.append(np.full(len(hashes), text))
        self._held += len(hashes)
        if self._held >= PIECE:
            self.settle()

    def settle(self) -> None:
        if not self._held:
            return
        owner = np.concatenate(self._owners)
        hashes = np.concatenate(self._lots).astype("<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        self.ones[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        self._lots, self._owners, self._held = [], [], 0

    def fingerprints(self) -> np.ndarray:
        self.settle()
        over = (2 * self.ones > self.n[:, None]).astype(np.uint8)
        return np.packbits(over, axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its fingerprint ``fp``, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part, data, at in blocks(batches, "text"):
            votes = _Votes(part.num_rows)
            for i in range(part.num_rows):
                for lot in shingles(data[at[i]:at[i + 1]].tobytes(), size):
                    votes.add(i, np.fromiter(map(xxhash.xxh64_intdigest, lot, repeat(SEED)), np.uint64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(votes.fingerprints())], names=["doc_id", "fp"])

    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- links


def _variants(rows: DataFrame, half: int) -> DataFrame:
    """One-wildcard variants of both halves of the free segment that starts at bit ``lo``.

    ``mask`` gains the half's bits but one; the other half is what the next cut works on.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("k")
    second = F.col("k") >= half
    at = F.col("lo") + F.when(second, half).otherwise(0)
    fixed = F.expr(f"shiftleft({(1 << half) - 1}L, at) & ~shiftleft(1L, lo + k)")
    return (rows.select("fp", "mask", "lo", every).withColumn("at", at)
            .select("fp", F.col("mask").bitwiseOR(fixed).alias("mask"),
                    (F.col("lo") + F.when(second, 0).otherwise(half)).alias("lo"))
            .select("fp", "mask", "lo", F.col("mask").bitwiseAND(F.col("fp")).alias("bits")))


def linked_groups(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among a key's fingerprints as a forest: each member with its group's first."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        near[lo:lo + 256] = np.bitwise_count(fps[lo:lo + 256, None] ^ fps[None, :]) <= REACH
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        edge = np.array([seed])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & (root < 0))
            root[edge] = seed
    tied = np.flatnonzero(root != np.arange(n))
    return fps[root[tied]], fps[tied]


def _compare(members: DataFrame) -> DataFrame:
    """Links of keys whose members (``mask``, ``bits``, ``fp``) are few, a key after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.column_stack([c.to_numpy() for c in batch.columns])])
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            if len(new):  # the last key may go on in the next batch
                yield _edges(rows[:new[-1]], np.concatenate([[0], new]))
                rows = rows[new[-1]:]
            rest = rows
        if len(rest):
            yield _edges(rest, np.array([0, len(rest)]))

    def _edges(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        found = [linked_groups(fps[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([f[side] for f in found]).view(np.int64)) for side in (0, 1)],
            names=["u", "v"])

    dealt = members.select("mask", "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that hold together all of ``fp`` at a distance of at most ``REACH``.

    ``distinct`` has each fingerprint once. Every linked pair ends in one component; a key
    returns fewer links than it has members.
    """
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("lo"))
    links = None
    for half in HALVES:
        index = _variants(rows, half)
        heads = keep(index.groupBy("mask", "bits").agg(
            F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
        pairs = heads.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= REACH).select("u", "v")
        # the keys grow with the documents: they are never broadcast
        crowds = heads.where("n > 2").select("mask", "bits", "n").hint("shuffle_merge")
        members = index.join(crowds, ["mask", "bits"])
        few = F.col("n") <= CROWD if half != HALVES[-1] else F.lit(True)
        found = pairs.unionAll(_compare(members.where(few)))
        links = found if links is None else links.unionAll(found)
        if half == HALVES[-1] or heads.where(F.col("n") > CROWD).isEmpty():
            break
        rows = keep(members.where(F.col("n") > CROWD).select("fp", "mask", "lo"))
    return links


# ---------------------------------------------------------------- documents


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")


def group_documents(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` (the smallest doc_id linked) of every document.

    Rows that share a fingerprint are dealt over ``DEAL`` keys for the join with its component.
    """
    drawn = keep(fingerprints(docs, size).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL)).cast("int")))
    dealt = keep(drawn.groupBy("fp", "deal").agg(F.min("doc_id").alias("least")))
    least = keep(dealt.groupBy("fp").agg(F.min("least").alias("least")))
    named = components(near_fingerprints(least.select("fp")))
    groups = keep(named.join(least, F.col("node") == F.col("fp")).select("fp", "component", "least"))
    roots = groups.groupBy("component").agg(F.min("least").alias("root"))
    rooted = groups.join(roots, "component").select("fp", "root")
    of_fp = least.join(rooted, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    of_deal = dealt.select("fp", "deal").join(of_fp, "fp")
    return drawn.join(of_deal, ["fp", "deal"]).select("doc_id", _hex("fp"), "component_id")
