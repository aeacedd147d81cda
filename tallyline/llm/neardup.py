"""Near-duplicates: MinHash signatures, a multi-index Hamming join, exact confirmation.

Method.  A document's set of word shingles gives ``N`` MinHash values, each cut to 16 bits:
the signature. Two signatures at Hamming distance (symbols that differ) of at most
``CHUNKS * 2 - 1`` have, by the pigeonhole principle, a chunk with at most one error; each
chunk is indexed under every choice of the one symbol that may be wrong, so any such pair
shares a key.

A key names a leader (its smallest member), and members within ``NEAR`` of the leader's
signature are linked to it. If others are further away, they are compared within the key,
with each other and with the shell of members further than ``NEAR - REACH``: by the triangle
inequality no pair within ``REACH`` that shares a key is parted. One task does so for up to
``CROWD`` of them; more are split on a further chunk, in which such a pair has at most its
even share of errors, until they are few or near. A key that no chunk is left for names
another leader, round by round.

The linked groups are confirmed on full sets. A group is checked in one task up to
``GROUP`` shingles in all. A larger one is dealt to blocks that each also hold a few pivots; what the
pivots leave apart (the sets outside the group's largest confirmed part) then meets every
block. Confirmed links make the components.

At similarity s a pair shares no key with chance (1 - s^6 - 6 s^5 (1 - s))^12: 2e-8 at 0.85,
3e-6 at 0.8. It is further apart than ``REACH`` with chance 1e-8 and 7e-6; only such a pair can
be lost to a leader, whatever other documents hold. Sets are 64-bit hashes.

Defined results: words are lower-cased in A-Z only; null or wordless text has an empty set
and is linked with nothing; fewer words than a shingle make one shingle; rows with equal
sets are one node, repeated rows as well; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, blocks, keep, mix64, shingle_hashes, span_hashes, word_bounds
from .components import components

CHUNKS, SIZE = 12, 6
N = CHUNKS * SIZE
NEAR, REACH = 44, 30
#: the comparisons among the members of a key that one task makes are the square of this
CROWD = 256
#: shingles of all sets of a group, or of a block, that one task compares; pivots of a large group
GROUP, PIVOTS = 2_000_000, 8

_RNG = np.random.Generator(np.random.PCG64(977))
_FLIP = _RNG.integers(1, 1 << 63, N, dtype=np.uint64)
_MULT = _RNG.integers(1, 1 << 63, N, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    starts, ends, first = word_bounds(data, at)
    words = span_hashes(_LOWER[data], starts, ends)
    every = shingle_hashes(words, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(every[lo:hi - size + 1]))
        else:
            out.append(shingle_hashes(words[lo:hi], hi - lo) if hi > lo else every[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash symbols, one row per set; empty sets get a row of zeros."""
    out = np.zeros((len(sets), N), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        items = np.concatenate([sets[i] for i in some])
        sizes = np.array([len(sets[i]) for i in some])
        starts = np.cumsum(sizes) - sizes
        for k in range(N):
            low = np.minimum.reduceat((items ^ _FLIP[k]) * _MULT[k], starts)
            out[some, k] = (mix64(low) >> np.uint64(48)).astype(np.uint16)
    return out


_PLACE = np.arange(N, dtype=np.uint64) << np.uint64(16)


def _terms(sig: np.ndarray) -> np.ndarray:
    return mix64((sig.astype(np.uint64) | _PLACE) + np.uint64(1)).reshape(-1, CHUNKS, SIZE)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For every signature its index keys: each chunk with each one of its symbols left out."""
    terms = _terms(sig)
    without = terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms
    return mix64(without.reshape(-1, N) ^ mix64(_PLACE + np.uint64(77)))


def errors_left(used: int) -> int:
    """Errors that a pair within REACH has at most in one of the chunks not in the bits of ``used``."""
    return REACH // max(1, CHUNKS - used.bit_count())


def split_keys(key: np.ndarray, sig: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """For every member of a key its further keys, and the chunks that these use.

    Two members within REACH, with at least the chunks in ``used`` behind them, share one.
    """
    chunks = [c for c in range(CHUNKS) if not used >> c & 1]
    outs = list(combinations(range(SIZE), errors_left(used)))
    stay = np.array([[i not in out for i in range(SIZE)] for out in outs], np.uint64)
    label = np.arange(len(chunks) * len(outs), dtype=np.uint64) + np.uint64(N)
    sums = (_terms(sig)[:, chunks, None, :] * stay).sum(axis=3, dtype=np.uint64).reshape(len(sig), -1)
    more = mix64(mix64(sums ^ mix64(label)) ^ key[:, None])
    return more, np.repeat([used | 1 << c for c in chunks], len(outs))


def _node(items: np.ndarray) -> int:
    """One number for a set: equal sets, and only they, are one node."""
    two = mix64(items + np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
    return int(mix64(np.array([two ^ np.uint64(len(items))]))[0].view(np.int64))


def _mark() -> Column:
    return F.xxhash64("text").alias("mark")


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Set size, node and signature of every document; ``mark`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            sets = shingle_sets(data, at, size)
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_node(s) for s in sets], pa.int64()),
                 pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "mark", "n_shingles", "node", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text", _mark()).mapInArrow(
        run, "doc_id long, mark long, n_shingles long, node long, sig binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sig = np.array([np.frombuffer(x, np.uint16) for x in part.column(1).to_pylist()])
                node = np.repeat(part.column(0).to_numpy(), N)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk_keys(sig).reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, N) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((a != b).sum(axis=1), pa.int32())],
                ["node", "lead", "far"])

    sig = nodes.select("node", "sig")
    both = (pairs.join(sig, "node")
            .join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("sig2")), "lead"))
    return both.select("node", "lead", "sig", "sig2").mapInArrow(run, "node long, lead long, far int")


def _split(crowds: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of crowded keys under further keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                node, key = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
                sig = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, N)
                used = part.column(2).to_numpy().copy()
                first = used == 0  # a first key doesn't say its chunk
                used[first] = 1 << (chunk_keys(sig[first]) == key[first, None]).argmax(axis=1) // SIZE
                for u in np.unique(used).tolist():
                    mine = used == u
                    keys, chunks = split_keys(key[mine], sig[mine], u)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node[mine], keys.shape[1])),
                         pa.array(np.tile(chunks, len(keys)).astype(np.int32))], ["key", "node", "used"])

    rows = crowds.select("node", "key", "used").join(nodes.select("node", "sig"), "node")
    return rows.select("node", "key", "used", "sig").mapInArrow(run, "key long, node long, used int")


def _compared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) within REACH of the members of each key in ``rows``, one of them apart, as stars."""

    def links(members: list[tuple[int, bool, bytes]]) -> list[tuple[int, int]]:
        node = [m[0] for m in members]
        sig = np.frombuffer(b"".join(m[2] for m in members), np.uint16).reshape(-1, N)
        found = []
        for i in (i for i, m in enumerate(members) if m[1]):
            found += [(node[i], node[j]) for j in np.flatnonzero((sig != sig[i]).sum(axis=1) <= REACH) if j != i]
        return stars(found)

    sent = rows.select("key", "node", "apart").join(nodes.select("node", "sig"), "node")
    return _by_tile(sent.select(F.col("key").alias("tile"), "node", "apart", "sig"), links)


def _leaders(rows: DataFrame) -> DataFrame:
    """Keys of several members and their smallest one; of keys with the same members one stays."""
    members = [F.min("node").alias("lead"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"),
               F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")]
    many = rows.groupBy("key").agg(*members).where("n > 1")
    return many.groupBy("lead", "n", "a", "b").agg(F.min("key").alias("key")).select("key", "lead")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) whose components hold every pair that shares a key and is within REACH."""
    rows, links = _keyed(nodes), None
    while True:
        led = rows.join(_leaders(rows), "key").where("node <> lead")
        led = keep(led if "used" in led.columns else led.withColumn("used", F.lit(0)))
        far = keep(_distances(led.select("node", "lead").distinct(), nodes))
        found = far.where(F.col("far") <= NEAR).select(F.col("node").alias("u"), F.col("lead").alias("v"))
        links = found if links is None else links.unionAll(found)
        # a key with all members near its leader is settled
        apart = led.join(far.where(F.col("far") > NEAR), ["node", "lead"])
        parted = keep(apart.groupBy("key").agg(F.count("*").alias("parted")))
        shell = keep(led.join(parted, "key").join(far.where(F.col("far") > NEAR - REACH), ["node", "lead"]).select(
            "key", "node", "used", "parted", (F.col("far") > NEAR).alias("apart")))
        left = keep(shell.join(shell.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
        fits = F.col("n") * F.col("parted") <= CROWD * CROWD
        links = links.unionAll(_compared(left.where(fits), nodes))
        crowds = left.where(~fits)
        if crowds.isEmpty():
            return links
        # by the bits of used: whether a chunk is left in which the errors leave a symbol
        whole = F.bit_count("used") <= max(k for k in range(CHUNKS) if errors_left((1 << k) - 1) < SIZE)
        rows = keep(_split(crowds.where(whole), nodes).unionByName(crowds.where(~whole).select("key", "node", "used")))


# ------------------------------------------------------------- confirmation


def link_sets(sets: list[np.ndarray], part: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join all parts with a pair of ``percent`` or more in common.

    Pairs already in one part are skipped, so a set's own family costs one comparison.
    """
    n, links = len(sets), []
    words, flat_ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    ids = [flat_ids[e - s:e] for s, e in zip(sizes, ends)]
    part = np.array(part)
    marked = np.zeros(len(words), bool)
    for i in range(n):
        # the smaller set must hold `percent` of the larger one
        fits = (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (part != part[i])
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        marked[ids[i]] = True
        for lo in range(0, len(others), 256):
            some = others[lo:lo + 256]
            some = some[part[some] != part[i]]
            if not len(some):
                continue
            hits = np.add.reduceat(marked[np.concatenate([ids[j] for j in some])],
                                   np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for j in some[100 * hits >= percent * (sizes[some] + sizes[i] - hits)]:
                if part[j] != part[i]:
                    links.append((i, int(j)))
                    part[part == part[j]] = part[i]
        marked[ids[i]] = False
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Every linked node but the smallest of its component, with that one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _by_tile(rows: DataFrame, links: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """What ``links`` gives for the rows of each tile (without the tile), as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            done: list[tuple[int, int]] = []
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if key != now and tile:
                    done += links(tile)
                    tile = []
                now = key
                tile.append(tuple(row))
            if done:
                yield out(done)
        if tile:
            yield out(links(tile))

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u long, v long")


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Links confirmed within each tile of ``rows`` (tile, node, part, items), as stars (u, v)."""

    def links(tile: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        unique = {node: (part, items) for node, part, items in tile}
        nodes = list(unique)
        if len(nodes) < 2:
            return []
        found = link_sets([np.frombuffer(unique[x][1], np.uint64) for x in nodes],
                          [unique[x][0] for x in nodes], percent)
        return stars([(nodes[i], nodes[j]) for i, j in found])

    return _by_tile(rows.select("tile", "node", "part", "items"), links)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full sets of the nodes in ``wanted`` (node, doc), from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", BLOCK):
            sets = shingle_sets(data, at, size)
            mine = np.array([_node(s) for s in sets], np.int64) == rows.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).filter(pa.array(mine)),
                 pa.array([s.tobytes() for s, m in zip(sets, mine) if m], pa.binary())], ["node", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    # texts and wanted nodes grow alike: the join shuffles at every size
    named = texts.alias("t").join(wanted.hint("merge").alias("w"), F.expr("t.doc <=> w.doc")).select(
        "w.node", "t.text")
    # a doc_id that stands in several rows gives each node once
    return named.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def _largest_part(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("grp", "part").agg(F.count("*").alias("n"))
    return sizes.groupBy("grp").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts"))


def confirmed(docs: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of the nodes of ``groups`` (grp, node, doc, size) with a confirmed link."""
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("sizes")), "grp")
    n_blocks = F.ceil(F.col("sizes") / GROUP).cast("int")
    members = keep(sized.withColumn("blocks", n_blocks)
                   .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                   .select("grp", "node", "doc", "n", "size", "blocks", "block"))
    sets = keep(_sets(docs, members.select("node", "doc"), size).join(members.drop("doc"), "node"))
    small = keep(_confirm(sets.where("blocks = 1").select(
        F.col("grp").alias("tile"), "node", F.col("node").alias("part"), "items"), percent))
    # a small group is all in one task: its stars are its components
    done = small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    large = members.where("blocks > 1")
    if large.isEmpty():
        return done
    return done.unionAll(components(_large_links(sets.where("blocks > 1"), large, percent)))


def _large_links(sets: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) of groups that are dealt to several blocks."""
    tile = F.xxhash64("grp", "at", "with")
    own = sets.withColumn("at", F.col("block")).withColumn("with", F.lit(0))
    # pivots: about PIVOTS sets of a group, by a hash
    pivots = (sets.where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS)
              .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("with", F.lit(0)))
    part = F.col("node").alias("part")
    first = keep(_confirm(own.unionByName(pivots).select(tile.alias("tile"), "node", part, "items"), percent))
    parts = components(first)
    state = keep(large.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
                 .select("grp", "node", "size", "blocks", "block", "part"))
    split = state.join(_largest_part(state).where("parts > 1"), "grp")
    minor = split.where("part <> main")
    if minor.isEmpty():
        return first
    minor = (minor.join(minor.groupBy("grp").agg(F.sum("size").alias("m")), "grp")
             .withColumn("pieces", F.ceil(F.col("m") / GROUP).cast("int"))
             .withColumn("with", F.pmod(F.xxhash64("node", F.lit(2)), F.col("pieces")).cast("int")))
    left = split.join(minor.groupBy("grp").agg(F.max("pieces").alias("pieces")), "grp")
    tiles = (left.withColumn("at", F.col("block"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select("grp", "node", "part", "at", "with").unionByName(
                 minor.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("grp", "node", "part", "at", "with")))
    rest = tiles.join(sets.select("node", "items"), "node").select(tile.alias("tile"), "node", "part", "items")
    return first.unionAll(_confirm(rest, percent))


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their nodes; nodes with their component and its smallest doc_id."""
    drawn = keep(sketch(docs, size))
    nodes = keep(drawn.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.max("n_shingles").alias("size")))
    groups = components(near_links(nodes)).select("node", F.col("component").alias("grp"))
    groups = keep(groups.join(nodes.select("node", "doc", "size"), "node"))
    linked = keep(confirmed(docs, groups, size, percent))
    least = linked.join(nodes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("root"))
    roots = keep(linked.join(least, "component").select("node", "component", "root"))
    named = (nodes.select("node", "doc").join(roots, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("root", "doc").alias("root")))
    return drawn.drop("sig"), named


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Every document's set size, component (its smallest doc_id) and whether it stays."""
    drawn, named = _labelled(docs, size, percent)
    empty = F.col("n_shingles") == 0
    return (drawn.join(named, "node", "left")
            .withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("root")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents, one of each component: its smallest doc_id, and of rows that share it one."""
    drawn, named = _labelled(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "mark")).alias("first")
    stay = (drawn.where("n_shingles > 0").join(named, "node").groupBy("component").agg(first).select("first.*")
            .unionByName(drawn.where("n_shingles = 0").select(
                F.col("doc_id").isNull().alias("none"), "doc_id", "node", "mark"))
            .select(_key("doc_id").alias("key"), "mark").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         _key("doc_id").alias("key"), _mark())
    return (packed.join(stay, ["key", "mark"], "left_semi")
            .withColumn("nth", F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(0))))
            .where("nth = 1").select("row.*"))


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
