"""Exact top-k by inner product over norm-bucketed vectors.

Vectors are turned into integers, sorted by length and packed into buckets of at most
``BUCKET``. Queries come in blocks. The longest bucket gives every query a first lower bound
of its k-th score. A query block then meets only the buckets long enough to reach the bound
(Cauchy-Schwarz: a prefix, as buckets come by length). In a bucket, the bound over the
product of lengths is a local cosine threshold; if it is high, the query is compared on its
largest coordinates first (each bounds the other vector's coordinate to an interval), else
by length. What remains is verified by the whole integer product, and the bound rises.

A stated query set meets all rows, in blocks. One number per bucket comes to the driver.

Defined results: a vector that is null, or holds a null or non-finite component, or whose id
is null, takes no part; vectors that are shorter count as zero in what they lack; equal
scores go by the smaller id; of rows that repeat, a query leaves out only its own row; with
fewer than k others all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

BUCKET, QUERIES = 2048, 512
#: from this local cosine on, coordinates are compared first, this many of them
COSINE, FOCUS = 0.8, 4
#: query blocks a task holds results of before it writes them out
HELD = 64
_EXACT = float(1 << 53)


def quantise(df: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Rows that take part: id, row number, length and integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, rows, lengths, items = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen += 1
                values = None if i is None or not x.is_valid or x.values.null_count else (
                    x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if values is None or not np.isfinite(values).all():
                    continue
                whole = np.floor(scale * values)
                ids.append(i)
                rows.append((part << 40) + seen)
                lengths.append(float(np.sqrt((whole * whole).sum())))
                items.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lengths, pa.float64()),
                 pa.array(items, pa.binary())], ["vec_id", "row", "length", "items"])

    return df.select(F.col(id_column).cast("long"), vector_column).mapInArrow(
        run, "vec_id long, row long, length double, items binary")


def pack(rows: DataFrame, size: int, total: int) -> DataFrame:
    """Rows by falling length in blocks of at most ``size``; ``block`` follows that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, []

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            nonlocal nth
            nth += 1
            wide = max(len(r[3]) for r in rows_)
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + nth, "n": len(rows_), "longest": rows_[0][2],
                "ids": np.array([r[0] for r in rows_], np.int64).tobytes(),
                "rows": np.array([r[1] for r in rows_], np.int64).tobytes(),
                "lengths": np.array([r[2] for r in rows_]).tobytes(),
                "items": b"".join(r[3].ljust(wide, b"\0") for r in rows_)}], schema)

        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("longest", pa.float64()),
                            *[(c, pa.binary()) for c in ("ids", "rows", "lengths", "items")]])
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(r)
                if len(held) == size:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    order = [F.col("length").desc(), F.xxhash64("vec_id", "row")]
    return (rows.repartitionByRange(max(1, total // (4 * size)), *order).sortWithinPartitions(*order)
            .mapInArrow(run, "block long, n int, longest double, ids binary, rows binary, lengths binary, "
                             "items binary"))


class Block:
    """A packed block as arrays."""

    def __init__(self, ids: bytes, rows: bytes, lengths: bytes, items: bytes):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.lengths = np.frombuffer(lengths)
        self.items = np.frombuffer(items).reshape(len(self.ids), -1)


def _products(q: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    wide = min(q.shape[1], b.shape[1])
    if top < _EXACT:
        return q[:, :wide] @ b[:, :wide].T
    whole = lambda x: np.array([[int(v) for v in r] for r in x[:, :wide]], object).reshape(len(x), wide)
    return np.clip(whole(q) @ whole(b).T, -(1 << 63), (1 << 63) - 1) if wide else np.zeros((len(q), len(b)))


def _near_enough(q: np.ndarray, length: float, b: Block, last: int, bound: float) -> np.ndarray:
    """Positions before ``last`` that no large coordinate of the query rules out."""
    least = bound / (length * b.lengths[0])
    unit = q / length
    wide = min(len(q), b.items.shape[1])
    keep_ = np.ones(last, bool)
    for f in np.argsort(-np.abs(unit[:wide]))[:FOCUS]:
        reach = np.sqrt(max(0.0, 1 - least * least) * (1 - unit[f] ** 2))
        other = b.items[:last, f] / np.maximum(b.lengths[:last], 1e-300)
        # at cosine c >= least the coordinate is at least unit * c - reach(c)
        ahead = np.sign(unit[f]) * other
        keep_ &= ahead >= abs(unit[f]) * least - reach - 1e-9
    return np.flatnonzero(keep_)


def search(q: Block, b: Block, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query the rows (positions) and scores in this bucket that may be among its k best."""
    top = float(q.lengths.max(initial=0)) * float(b.lengths.max(initial=0))
    none = (np.zeros(0, np.int64), np.zeros(0))
    # buckets come by falling length: a query needs a prefix
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bound > 0, bound / np.maximum(q.lengths, 1e-300) * (1 - 1e-12), -np.inf)
        local = np.where(bound > 0, bound / (q.lengths * b.lengths[0]), -1.0)
    last = np.searchsorted(-b.lengths, -need, "right")
    by_length = np.flatnonzero((last > 0) & ~(local >= COSINE))
    scores = {}
    if len(by_length):
        some = _products(q.items[by_length], b.items[:last[by_length].max()], top)
        scores = dict(zip(by_length.tolist(), some))
    out = []
    for i in range(len(q.ids)):
        if not last[i]:
            out.append(none)
            continue
        if i in scores:
            value = scores[i][:last[i]]
            at = np.flatnonzero(value >= bound[i])
            value = value[at]
        else:
            at = _near_enough(q.items[i], q.lengths[i], b, last[i], bound[i])
            value = _products(q.items[i:i + 1], b.items[at], top)[0]
            at, value = at[value >= bound[i]], value[value >= bound[i]]
        own = b.rows[at] != q.rows[i]
        out.append((at[own], value[own]))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


_Q = ("ids", "rows", "lengths", "items")


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """Up to k best rows per query of each block and task, from pairs of a query block and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def out() -> pa.RecordBatch:
            got = [(qi, qr, vi, s) for q, found, _ in held.values()
                   for qi, qr, (vi, s) in zip(q.ids, q.rows, found)]
            size = [len(g[2]) for g in got]
            held.clear()
            join = lambda i, kind: np.concatenate([g[i] for g in got] + [np.zeros(0, kind)]).astype(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([g[i] for g in got], np.int64), size)) for i in (0, 1)]
                + [pa.array(join(2, np.int64)), pa.array(join(3, np.int64))],
                ["query_id", "query_row", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                b = Block(*(r[c] for c in _Q))
                if r["q_block"] not in held:
                    if len(held) >= HELD:
                        yield out()
                    q = Block(*(r[f"q_{c}"] for c in _Q))
                    held[r["q_block"]] = (q, [(np.zeros(0, np.int64), np.zeros(0))] * len(q.ids),
                                          np.frombuffer(r["bound"]).copy())
                q, found, bound = held[r["q_block"]]
                for i, (at, value) in enumerate(search(q, b, bound, k)):
                    if len(at):
                        ids = np.concatenate([found[i][0], b.ids[at]])
                        value = np.concatenate([found[i][1], value])
                        top = best(ids, value, k)
                        found[i] = (ids[top], value[top])
                        if len(top) == k:
                            bound[i] = max(bound[i], float(value[top[-1]]))
        if held:
            yield out()

    return pairs.mapInArrow(run, "query_id long, query_row long, vec_id long, score long")


def _bounded(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th score so far as ``bound`` and the length needed."""
    kth = (found.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
           .where(F.col("n") >= k).join(
               blocks.select("block", F.explode(F.col("row_list")).alias("query_row")), "query_row")
           .groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_row", "least"))).alias("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, needs = [], []
            for r in batch.to_pylist():
                least = dict(r["least"] or [])
                bound = np.array([float(least.get(x, -np.inf)) for x in np.frombuffer(r["rows"], np.int64).tolist()])
                lengths = np.frombuffer(r["lengths"])
                need = np.where(bound > 0, bound / np.maximum(lengths, 1e-300), -np.inf)
                bounds.append(bound.tobytes())
                needs.append(float(need.min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bounds, pa.binary()), pa.array(needs, pa.float64())],
                ["block", "bound", "need"])

    return (blocks.select("block", "rows", "lengths").join(kth, "block", "left")
            .select("block", "rows", "lengths", "least")
            .mapInArrow(run, "block long, bound binary, need double"))


def top_k(df: DataFrame, is_query: Column, k: int, scale: int = 64, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for every query: query_id, rank, vec_id, score."""
    rows = keep(quantise(df, scale, id_column, vector_column))
    queries = rows.where(is_query)
    n_rows, n_queries = (x.count() for x in (rows, queries))
    buckets = keep(pack(rows, BUCKET, n_rows))
    blocks = keep(pack(queries, QUERIES, n_queries))
    index = sorted((r["block"], r["longest"], r["n"]) for r in buckets.select("block", "longest", "n").collect())
    starts, longest = [r[0] for r in index], np.array([r[1] for r in index])
    # a bound must come from k rows besides the query's own
    seeds, have = [], 0
    while len(seeds) < len(starts) and have <= k:
        have += index[len(seeds)][2]
        seeds.append(starts[len(seeds)])

    def against(left: DataFrame) -> DataFrame:
        q = left.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in _Q], "bound",
                        F.explode("meets").alias("block"))
        return q.join(buckets.select("block", *_Q), "block").select(
            "q_block", *[f"q_{c}" for c in _Q], "bound", *_Q)

    open_ = blocks.withColumn("meets", F.array(*[F.lit(s) for s in seeds]).cast("array<long>")).withColumn(
        "bound", F.lit(None).cast("binary"))

    def unbounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = [np.full(n, -np.inf).tobytes() for n in batch.column(1).to_pylist()]
            rows_ = [np.frombuffer(x, np.int64).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bound, pa.binary()), pa.array(rows_, pa.list_(pa.int64()))],
                ["block", "bound", "row_list"])

    start = keep(blocks.select("block", "n", "rows").mapInArrow(
        unbounded, "block long, bound binary, row_list array<long>"))
    first = keep(_meet(against(open_.drop("bound").join(start.drop("row_list"), "block")), k))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    cut = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bounds = _bounded(blocks.join(start.drop("bound"), "block"), cut, k)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [int(np.searchsorted(-longest, -x * (1 - 1e-12), "right")) if x > 0 else len(starts)
                    for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([starts[:n] for n in last], pa.list_(pa.int64()))], ["block", "bound", "meets"])

    meets = keep(bounds.mapInArrow(meeting, "block long, bound binary, meets array<long>"))
    found = _meet(against(blocks.join(meets, "block")), k)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
