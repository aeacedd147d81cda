"""Exact substring deduplication by maximal repeats from enhanced suffix arrays.

A byte is removed if a string of ``LEAST`` bytes that covers it also starts in a document
with a smaller doc_id. Strings are judged on the input.

1. *Neighbourhoods.*  Every string of ``LEAST`` bytes belongs to its smallest 16-byte gram
   (by hash), which the string alone decides. Runs of strings with one gram are a
   neighbourhood: the bytes those strings cover, at most ``2 * LEAST - GRAM`` of them. A
   repeat of ``LEAST`` bytes or more is a repeat in the neighbourhoods of one gram.
2. *Grams in more than one place.*  Blocks of documents deal the hashes of their distinct
   grams to buckets; a bucket answers, one bit per gram, which of them have two different
   neighbourhoods or stand in two blocks. All others can't repeat across blocks.
3. *Maximal repeats.*  The distinct neighbourhoods of those grams, each with its smallest
   doc_id, are dealt by gram. Each task builds the suffix array of its neighbourhoods with
   common-prefix lengths, walks the interval tree with a stack, and takes the intervals whose
   left extensions differ: maximal repeats with all their occurrences. In every group, the
   occurrences in documents above the group's smallest are covered.
4. *Removal.*  Blocks gather the covered strings of their neighbourhoods, and cut the bytes.

Equal neighbourhoods within a block travel once, with their smallest document; the others
are covered whole. A gram with more than ``WIDE`` neighbourhoods (one end of a passage that
very many documents share) is dealt string by string instead, by the hash of the string, so
no gram fills a task: each string travels once from a block.

Defined results: null text is empty; a null doc_id is above all others, and equal ids are not
smaller than each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix64
from .suffix import GRAM, Suffixes, gram_hashes, maximal_repeats, range_hashes

LEAST = 50
SPAN = LEAST - GRAM + 1
#: neighbourhoods of one gram that are dealt by the gram
WIDE = 1024
#: text bytes of a block, text bytes a bucket stands for, bytes worked on at once
BLOCK_TEXT, BUCKET_TEXT, PART = 4 << 20, 4 << 20, 1 << 20
#: occurrences of repeats gone through at once
OCCURRENCES = 1 << 20
_CODEC = pa.Codec("zstd", compression_level=1)
_ABOVE = np.iinfo(np.int64).max


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive items."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


class Block:
    """The neighbourhoods of a block of documents, in an order that only its rows decide."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks().fill_null(_ABOVE).to_numpy()
        data, at = flat(table.column("text"))
        digest = [hashlib.md5(data[a:b].tobytes()).digest() for a, b in zip(at[:-1], at[1:])]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], digest[i]))
        self.data = np.concatenate([data[at[i]:at[i + 1]] for i in order] + [data[:0]])
        self.ids = ids[order]
        self.null = np.array([not v.is_valid for v in table.column("doc_id")], bool)[order]
        self.at = np.concatenate([[0], np.cumsum(np.diff(at)[order])])
        self.owner = np.repeat(np.arange(len(order), dtype=np.int32), np.diff(self.at))
        parts = [self._part(lo) for lo in range(0, max(len(self.data) - LEAST + 1, 0), PART)]
        gram, mark, start, end, text = (np.concatenate(x) for x in zip(*parts)) if parts else (
            *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)
        by = np.lexsort((self.ids[text], mark, gram))
        self.gram, self.start, self.end, self.text, mark = (x[by] for x in (gram, start, end, text, mark))
        first = np.ones(len(by), bool)
        first[1:] = (self.gram[1:] != self.gram[:-1]) | (mark[1:] != mark[:-1])
        # of equal neighbourhoods the first has the smallest document
        self.own = np.cumsum(first) - 1
        self.first = np.flatnonzero(first)
        self.doc = self.ids[self.text[self.first]] if len(by) else np.zeros(0, np.int64)
        self.kinds, self.kind, self.count = np.unique(
            self.gram[self.first], return_inverse=True, return_counts=True)

    def _part(self, lo: int) -> tuple[np.ndarray, ...]:
        """Neighbourhoods of the strings that start in [lo, lo + PART)."""
        data = self.data[lo:lo + PART + LEAST - 1]
        grams = gram_hashes(data)
        low = _lowest(grams, SPAN)
        text = self.owner[lo:lo + len(low)]
        inside = text == self.owner[lo + LEAST - 1:lo + LEAST - 1 + len(low)]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        opens = np.flatnonzero(new)
        # a run longer than one gram allows (periodic text) is cut, by its own start
        size = np.diff(np.append(opens, len(low)))
        for first, n in zip(*(x[size > SPAN].tolist() for x in (opens, size))):
            new[first:first + n:SPAN] = True
        opens = np.flatnonzero(new & inside)
        # strings that cross into the next text come last in its run: a run ends before them
        past = np.append(np.flatnonzero(new | ~inside), len(low))
        shut = past[np.searchsorted(past, opens, "right")]
        start, end = lo + opens, lo + shut - 1 + LEAST
        mark = range_hashes(grams, opens, shut - 1 + LEAST, 2 * LEAST - GRAM) if len(opens) else low[:0]
        return low[opens], mark, start, end, text[opens].astype(np.int64)

    def buckets(self, hashes: np.ndarray, n: int) -> np.ndarray:
        return (mix64(hashes + np.uint64(9)) >> np.uint64(20)) % np.uint64(n)

    def shared(self, answers: pa.Table | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every gram whether its neighbourhoods must be compared, and whether they are many."""
        live, wide = np.zeros(len(self.kinds), bool), np.zeros(len(self.kinds), bool)
        bucket = self.buckets(self.kinds, n)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
        for b, x, y in zip(*(answers.column(c).to_pylist() for c in ("bucket", "live", "wide"))) if answers else ():
            mine = order[edges[b]:edges[b + 1]]
            live[mine], wide[mine] = (np.unpackbits(np.frombuffer(v, np.uint8), count=len(mine)) for v in (x, y))
        return live, wide


_GRAMS = "bucket long, block long, grams binary, counts binary"
_ANSWERS = "block long, bucket long, live binary, wide binary"
_PLACES = "key long, block long, docs binary, refs binary, sizes binary, bytes binary"
_COVERED = "block long, refs binary, strings binary"


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, one after the other."""
    opens = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum(), dtype=np.int32)  # a block is far below 2 GB
    at += np.repeat((starts - opens).astype(np.int32), sizes)
    return data[at]


def _table(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _grams(n: int):
    """Distinct grams of a block (48 bits of the hash) and their neighbourhood counts, by bucket."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = Block(table)
        bucket = b.buckets(b.kinds, n)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edges))
        # bytes of equal rank together: the last two are left out, the counts' are mostly alike
        planes = np.ascontiguousarray(b.kinds[order]).view(np.uint8).reshape(-1, 8)[:, :6]
        counts = np.minimum(b.count[order], WIDE + 1).astype("<u2")
        cut = [slice(edges[i], edges[i + 1]) for i in full]
        return _table([("bucket", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())],
                      [full, [key[0].as_py()] * len(full), [planes[c].T.tobytes() for c in cut],
                       [counts[c].tobytes() for c in cut]])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Which grams of a bucket have two neighbourhoods or more in all, and which have many."""
    rows = [np.frombuffer(x, np.uint8).reshape(6, -1).T for x in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()])
    hashes = np.zeros((len(counts), 8), np.uint8)
    hashes[:, :6] = np.concatenate(rows)
    _, which = np.unique(hashes.view(np.uint64)[:, 0], return_inverse=True)
    total = np.bincount(which, counts)[which]
    ends = np.cumsum([len(r) for r in rows])[:-1]
    bits = [[np.packbits(x).tobytes() for x in np.split(total > least, ends)] for least in (1, WIDE)]
    return pa.Table.from_arrays(
        [table.column("block"), table.column("bucket"), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())],
        ["block", "bucket", "live", "wide"])


def _pack_places(b: Block, block: int, keys: np.ndarray, docs: np.ndarray, refs: np.ndarray,
                 starts: np.ndarray, ends: np.ndarray) -> list[list]:
    """Rows of _PLACES: byte ranges of a block by key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else []
    out = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        i = order[lo:hi]
        size = ends[i] - starts[i]
        out.append([int(keys[i[0]]), block, docs[i].view(np.uint8).reshape(-1, 8).T.tobytes(),
                    refs[i].astype("<u8").tobytes(), size.astype(np.uint8).tobytes(),
                    _CODEC.compress(_gather(b.data, starts[i], size).tobytes(), asbytes=True)])
    return out


def _places(n: int):
    """Neighbourhoods to compare; strings of grams that have too many; what the block itself covers.

    A reference is a neighbourhood's number and the place of its first string: number * 64 + place.
    """
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = [("key", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in (
            "docs", "refs", "sizes", "bytes")]]
        if not texts.num_rows or not answers.num_rows:
            return _table(schema, [[]] * 6)
        b, block = Block(texts), key[0].as_py()
        live, wide = b.shared(answers, n)
        start, end = b.start[b.first], b.end[b.first]
        plain = np.flatnonzero((live & ~wide)[b.kind])
        rows = _pack_places(b, block, b.buckets(b.gram[b.first][plain], n).astype(np.int64), b.doc[plain],
                            plain * 64, start[plain], end[plain])
        many = np.flatnonzero(wide[b.kind])
        if len(many):
            count = end[many] - start[many] - LEAST + 1
            ref = np.repeat(many, count)
            place = np.arange(len(ref)) - np.repeat(np.cumsum(count) - count, count)
            at = start[ref] + place
            size = end[many] - start[many]
            opens = np.cumsum(size) - size
            held = _gather(b.data, start[many], size)
            inside = np.repeat(opens, count) + place
            head = range_hashes(gram_hashes(held), inside, inside + LEAST, LEAST)
            by = np.lexsort((b.doc[ref], head))
            same = np.concatenate([[False], head[by][1:] == head[by][:-1]])
            group = np.cumsum(~same) - 1
            least = b.doc[ref[by]][~same][group]
            # a string of the block's smallest document asks the others; the rest is covered here
            ask = b.doc[ref[by]] == least
            mine, rest = by[ask], by[~ask]
            rows += _pack_places(b, block, (n + b.buckets(head[mine], n)).astype(np.int64), b.doc[ref[mine]],
                                 ref[mine] * 64 + place[mine], at[mine], at[mine] + LEAST)
            rows.append([-1 - block, block, b"", (ref[rest] * 64 + place[rest]).astype("<u8").tobytes(), b"", b""])
        return _table(schema, list(zip(*rows)) if rows else [[]] * 6)
    return run


def repeat_groups(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray):
    """Maximal repeats of places, many at a time, as arrays: each occurrence's group, text and
    position in the text, each group's length and smallest document."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    s = Suffixes(data, starts, ends, LEAST)
    found = maximal_repeats(s, LEAST)
    while True:
        groups, n = [], 0
        for g in found:
            groups.append(g)
            n += g[2] - g[1]
            if n >= OCCURRENCES:
                break
        if not groups:
            return
        length, lo, hi = np.array(groups).T
        size = hi - lo
        opens = np.cumsum(size) - size
        member = np.arange(n) - np.repeat(opens - lo, size)
        text = s.text[member]
        yield (np.repeat(np.arange(len(groups)), size), text, s.at[member] - starts[text], length,
               np.minimum.reduceat(docs[text], opens))


def _cover(table: pa.Table) -> pa.Table:
    """Strings of every block that a smaller document has, from the maximal repeats of a key."""
    schema = [("block", pa.int64()), ("refs", pa.binary()), ("strings", pa.binary())]
    columns = {c: table.column(c).to_pylist() for c in ("block", "docs", "refs", "sizes", "bytes")}
    refs = [np.frombuffer(x, "<u8").astype(np.int64) for x in columns["refs"]]
    if columns["docs"] and not columns["docs"][0] and not columns["bytes"][0]:
        return _table(schema, [columns["block"], columns["refs"],
                               [np.ones(len(r), "<u8").tobytes() for r in refs]])
    docs = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.int64)[:, 0] for x in columns["docs"]])
    sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in columns["sizes"]]).astype(np.int64)
    raw = [_CODEC.decompress(x, int(np.frombuffer(n, np.uint8).sum(dtype=np.int64)), asbytes=True)
           for x, n in zip(columns["bytes"], columns["sizes"])]
    data = np.frombuffer(b"".join(raw), np.uint8)
    # equal places are one text of the array, with their smallest document
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = range_hashes(gram_hashes(data), starts, ends, 2 * LEAST - GRAM)
    order = np.lexsort((docs, mark))
    first = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    one = order[first]
    size = sizes[one]
    strings = np.zeros(len(one), np.uint64)
    lowest = docs[one]
    for group, text, place, length, least in repeat_groups(lowest, size, _gather(data, starts[one], size)):
        above = lowest[text] > least[group]
        run = (np.uint64(1) << (length[group[above]] - LEAST + 1).astype(np.uint64)) - np.uint64(1)
        np.bitwise_or.at(strings, text[above], run << place[above].astype(np.uint64))
    # a place above its like's smallest document is covered whole
    full = (np.uint64(1) << (sizes - LEAST + 1).astype(np.uint64)) - np.uint64(1)
    covered = np.where(docs > lowest[which], full, strings[which])
    out: list[list] = [[], [], []]
    cut = np.cumsum([len(r) for r in refs])
    for block, r, hi in zip(columns["block"], refs, cut):
        mine = covered[hi - len(r):hi]
        some = mine != 0
        if some.any():
            for column, value in zip(out, (block, r[some].astype("<u8").tobytes(), mine[some].astype("<u8").tobytes())):
                column.append(value)
    return _table(schema, out)


_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
           ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _remove(key: tuple, texts: pa.Table, covered: pa.Table) -> pa.Table:
    """Every document of a block with the spans that go and the checksum of what stays."""
    if not texts.num_rows:
        return _table(_RESULT, [[]] * len(_RESULT))
    b = Block(texts)
    strings = np.zeros(len(b.first), np.uint64)
    for refs, bits in zip(*(covered.column(c).to_pylist() for c in ("refs", "strings"))):
        ref = np.frombuffer(refs, "<u8").astype(np.int64)
        np.bitwise_or.at(strings, ref // 64, np.frombuffer(bits, "<u8") << (ref % 64).astype(np.uint64))
    whole = b.ids[b.text] > b.doc[b.own] if len(b.own) else np.zeros(0, bool)
    edge = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(edge, b.start[whole], 1)
    np.add.at(edge, b.end[whole], -1)
    rest = np.flatnonzero(~whole)
    rest = rest[strings[b.own[rest]] != 0]
    bits = strings[b.own[rest]]
    for place in range(SPAN):
        some = b.start[rest[(bits >> np.uint64(place)) & np.uint64(1) == 1]] + place
        np.add.at(edge, some, 1)
        np.add.at(edge, some + LEAST, -1)
    gone = np.cumsum(edge[:-1]) > 0
    # where removed bytes begin and end; a text's ends cut a run
    before, after = gone.copy(), gone.copy()
    before[1:] &= gone[:-1]
    before[b.at[:-1][b.at[:-1] < len(gone)]] = False
    after[:-1] &= gone[1:]
    after[b.at[1:][b.at[1:] > 0] - 1] = False
    opens, shuts = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    turns = np.stack([opens, shuts], axis=1).reshape(-1)
    cuts = 2 * np.searchsorted(opens, b.at)
    removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
    rows = []
    for i, (lo, hi) in enumerate(zip(b.at[:-1].tolist(), b.at[1:].tolist())):
        mine = gone[lo:hi]
        turn = turns[cuts[i]:cuts[i + 1]].reshape(-1, 2) - lo
        rows.append((None if b.null[i] else int(b.ids[i]), hi - lo, int(removed[hi] - removed[lo]), len(turn),
                     hashlib.sha256((b.data[lo:hi][~mine] if len(turn) else b.data[lo:hi]).tobytes()).hexdigest(),
                     [{"start": x, "end": y} for x, y in turn.tolist()]))
    return _table(_RESULT, list(zip(*rows)))


def removed_repeats(docs: DataFrame) -> DataFrame:
    """Every document's bytes, removed bytes and spans, and the checksum of what stays."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n = (max(1, -(-total // size)) for size in (BLOCK_TEXT, BUCKET_TEXT))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
                        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # the plans below read one exchange of the texts by block
    grams = texts.groupBy("block").applyInArrow(_grams(n), _GRAMS)
    answers = grams.groupBy("bucket").applyInArrow(_answer, _ANSWERS)
    places = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_places(n), _PLACES)
    covered = places.groupBy("key").applyInArrow(_cover, _COVERED)
    return texts.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                 "spans array<struct<start:long,end:long>>")


def remove_from_documents(docs: DataFrame) -> DataFrame:
    return removed_repeats(docs).drop("spans")
