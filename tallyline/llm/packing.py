"""Concatenate and cut: documents as one token stream, cut into fixed windows.

Pass one tokenizes every document once and writes the ids with their place inside the
partition. The partitions' totals are summed to global offsets (one number per task comes
to the driver). Pass two cuts the stream at multiples of the window, and sends no ids between tasks. A
window that lies across two partitions is kept as boundary records, which ``sequences``
joins; all others are complete where they are.

Defined results: null text counts as empty, a document without text is its end id alone,
rows that repeat are packed as often as they come, an empty table gives no piece. Only the
last window can be short: it is padded to the window, or not at all at a power of two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

WINDOW = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 1
#: the merge of one unbroken run is quadratic in the fast library; longer runs take the other
LONG_RUN = 4000
#: offsets of up to so many partitions (about 3 MB) are sent to every executor
PARTS_SENT = 100_000


@cache
def _encoders(vocabulary: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    exact.encode_special_tokens = True  # their strings in a text are ordinary text
    return fast, exact


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Token ids of one text. Both libraries hold the same vocabulary and give the same ids."""
    fast, exact = _encoders(vocabulary)
    if len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN
                                 or max(map(len, _gaps(text)), default=0) > LONG_RUN):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def _gaps(text: str) -> Iterator[str]:
    import re
    return (m[0] for m in re.finditer(r"\s{64,}", text))


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Ids of every document (little-endian, 4 bytes each), its partition and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = [np.concatenate([encode(t or "", vocabulary), end]).astype("<u4")
                       for t in rows.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts),
                     pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "before", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        run, "doc_id long, part int, before long, doc_tokens long, ids binary")


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY,
           end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its ids, sequence and offset there."""
    spark = docs.sparkSession
    tokens = keep(tokenize(docs, vocabulary, end_id))
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()
    totals.sort(key=lambda r: r["part"])
    base, bases = 0, []
    for r in totals:
        bases.append((r["part"], base, base + r["n"]))
        base += r["n"]
    whole = base
    bounds = spark.createDataFrame(bases, "part int, first long, past long")
    if len(bases) <= PARTS_SENT:
        bounds = F.broadcast(bounds)  # else a join that shuffles

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at, first, past = (batch.column(batch.schema.get_field_index(c)).to_numpy()
                                      for c in ("doc_tokens", "at", "first", "past"))
            n = (at + sizes - 1) // window - at // window + 1
            row = np.repeat(np.arange(batch.num_rows), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sequence = at[row] // window + nth
            start = np.maximum(at[row], sequence * window)
            length = np.minimum(at[row] + sizes[row], (sequence + 1) * window) - start
            full = np.minimum(window, whole - sequence * window)
            padded = np.where((full & (full - 1)) == 0, full, window)
            split = (sequence * window < first[row]) | (sequence * window + full > past[row])
            lo, raw = 4 * (start - at[row]), batch.column(batch.schema.get_field_index("ids"))
            views = [raw[i].as_buffer() for i in range(batch.num_rows)]
            parts = [views[i].slice(a, b) for i, a, b in
                     zip(row.tolist(), lo.tolist(), (4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)),
                 pa.array(lo // 4), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                 pa.array(sizes[row]), pa.array(sequence), pa.array(start - sequence * window),
                 pa.array(padded), pa.array(split), pa.array([x.to_pybytes() for x in parts], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                 "padded_to", "boundary", "ids"])

    placed = tokens.join(bounds, "part").withColumn("at", F.col("first") + F.col("before"))
    return placed.select("doc_id", "doc_tokens", "at", "first", "past", "ids").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
             "offset long, padded_to long, boundary boolean, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order, unpadded, and the length to pad to.

    Pieces of one sequence are at most ``window`` rows, so a group is bounded.
    """
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(order.alias("parts"), F.max("padded_to").alias("padded_to"))
            .select("sequence_id", "padded_to",
                    F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of all documents at production parameters, without the ids themselves."""
    return pieces(docs).drop("ids")
