"""Helpers the operators share: scratch tables, and whole texts as flat arrays of bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a run of characters between spaces and the control characters 9 to 13
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir.

    Only a session on one machine may do without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs a re-read."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a table that keep() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- flat text

#: bytes of text worked on at once; a longer single text is a block of its own
BLOCK = 1 << 21
#: texts worked on at once, however short
ROWS = 1 << 14
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # a null may keep bytes of its own
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        keep_ = np.repeat(sizes == np.diff(at), np.diff(at))
        return body[at[0]:at[-1]][keep_], np.concatenate([[0], np.cumsum(sizes)])
    return body[at[0]:at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = BLOCK, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that each part holds about ``limit`` bytes of text, and at most ``rows`` texts."""
    for batch in batches:
        data, at = flat(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), lo + rows)
            yield batch.slice(lo, hi - lo), data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~_IS_SPACE[data]
    breaks = np.zeros(n + 1, bool)
    breaks[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | breaks[1:n]
    last[:-1] &= ~solid[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that neither overlap nor are empty.

    A span is read in pieces of eight bytes, each mixed with its place before they are added.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.concatenate([[0], np.cumsum(pieces)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))
    value = eight[np.repeat(starts, pieces) + 8 * nth].astype(np.uint64)
    spare = 8 - np.minimum(np.repeat(size, pieces) - 8 * nth, 8)
    value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * spare).astype(np.uint64)
    value = mix64(value ^ mix64(nth.astype(np.uint64) + _ODD))
    return mix64(np.add.reduceat(value, first[:-1]) ^ (size.astype(np.uint64) * _ODD))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes; item i covers words i to i + size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _ODD
        out ^= out >> np.uint64(29)
        out += words[k:k + n]
    return mix64(out)
