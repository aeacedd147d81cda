"""Repeats, near-duplicates and exact search."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import as_docs
from pyspark.sql import functions as F

from tallyline.llm import neardup, repeats, suffix, topk
from tallyline.llm.components import components

# ------------------------------------------------------------------ repeats


def brute_removal(rows):
    """By a table of all 50-byte strings."""
    top = 1 << 62
    rows = [(top if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in rows:
        for p in range(len(raw) - 49):
            s = raw[p:p + 50]
            least[s] = min(i, least.get(s, top))
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if least[raw[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((None if i == top else i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(df):
    return sorted((tuple(r) for r in repeats.remove_from_documents(df).collect()), key=str)


def test_removal_on_all_documents(docs):
    assert removal(docs) == brute_removal(docs.select("doc_id", "text").collect())


def test_removal_on_odd_documents(odd_docs, odd_texts, spark, no_docs):
    assert removal(odd_docs) == brute_removal(list(enumerate(odd_texts)))
    rows = [(None, "x" * 60), (None, "x" * 60), (5, "y" + "x" * 60), (5, "x" * 70), (7, None)]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == brute_removal(rows)
    assert removal(no_docs) == []


def in_one_process(rows, n_blocks, n, rng):
    """The operator's steps over blocks dealt at random."""
    def by(table, name):
        keys = np.array(table.column(name).to_pylist())
        return {k: table.filter(pa.array(keys == k)) for k in sorted(set(keys.tolist()))}

    dealt = {}
    for i, t in rows:
        dealt.setdefault(rng.randrange(n_blocks), []).append((i, t))
    blocks = {k: pa.table({"doc_id": pa.array([i for i, _ in v], pa.int64()),
                           "text": pa.array([t or "" for _, t in v], pa.string())}) for k, v in dealt.items()}
    grams = pa.concat_tables([repeats._grams(n)((pa.scalar(k),), t) for k, t in blocks.items()])
    answers = pa.concat_tables([repeats._answer(t) for t in by(grams, "bucket").values()]) if grams.num_rows else grams
    answers = by(answers, "block") if grams.num_rows else {}
    places = pa.concat_tables([repeats._places(n)((pa.scalar(k),), t, answers[k]) for k, t in blocks.items()
                               if k in answers]) if answers else None
    covered = pa.concat_tables([repeats._cover(t) for t in by(places, "key").values()]) if places and places.num_rows else None
    covered = by(covered, "block") if covered else {}
    none = pa.table({"refs": pa.array([], pa.binary()), "strings": pa.array([], pa.binary())})
    out = []
    for k, t in blocks.items():
        got = repeats._remove((pa.scalar(k),), t, covered.get(k, none)).drop(["spans"])
        out += [tuple(r.values()) for r in got.to_pylist()]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(60))
def test_removal_with_small_blocks_and_crowded_grams(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(repeats, "WIDE", rng.choice([1, 2, 4, 1024]))
    monkeypatch.setattr(repeats, "PART", rng.choice([64, 200, 1 << 20]))
    letters = rng.choice(["ab", "abcdefgh ", "aé "])
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [some(rng.randrange(30, 300)) for _ in range(4)]
    rows = []
    for i in range(rng.randrange(1, 30)):
        text = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += some(rng.randrange(80)) + rng.choice([p, p[a:], p[:a]])
        if rows and rng.random() < 0.15:
            text = rng.choice(rows)[1]
        rows.append((rng.choice([i, i, 3]), rng.choice([text] * 8 + ["a" * 200, None])))
    assert in_one_process(rows, rng.choice([1, 3, 9]), rng.choice([1, 4]), rng) == brute_removal(rows)


def brute_maximal(texts, least):
    """Repeats that neither a common next nor a common previous byte extends."""
    where = {}
    for t, text in enumerate(texts):
        for a in range(len(text)):
            for b in range(a + least, len(text) + 1):
                where.setdefault(text[a:b], []).append((t, a))
    out = set()
    for s, places in where.items():
        before = {texts[t][a - 1] if a else (t, "start") for t, a in places}
        after = {texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, "end") for t, a in places}
        if len(places) > 1 and len(before) > 1 and len(after) > 1:
            out.add((len(s), tuple(sorted(places))))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_interval_tree_gives_all_maximal_repeats(seed):
    rng, least = random.Random(seed), 16
    seedling = bytes(rng.choice(b"ab") for _ in range(40))
    texts = []
    for _ in range(rng.randrange(2, 6)):
        a = rng.randrange(20)
        texts.append(bytes(rng.choice(b"abc") for _ in range(rng.randrange(8))) + seedling[a:a + rng.randrange(16, 40)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    fit = [i for i, t in enumerate(texts) if len(t) >= least]
    s = suffix.Suffixes(data, starts[fit], ends[fit], least)
    got = set()
    for length, lo, hi in suffix.maximal_repeats(s, least):
        group = tuple(sorted((fit[t], int(at - starts[fit[t]])) for t, at in zip(s.text[lo:hi], s.at[lo:hi])))
        got.add((length, group))
    assert got == brute_maximal(texts, least)


# ---------------------------------------------------------- near-duplicates


def brute_components(rows, size, percent):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words.findall((t or "").translate(lower))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets))


def near(df, size, percent):
    return sorted(tuple(r) for r in neardup.near_duplicates(df, size, percent).collect())


def family(rng, n, words=120, edits=3):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, size, percent):
    rng = random.Random(size)
    texts = [t for n in (2, 3, 5, 40) for t in family(rng, n)] + [t for t in family(rng, 30, 120, 9)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    assert near(as_docs(spark, texts), size, percent) == brute_components(list(enumerate(texts)), size, percent)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert near(docs, size, percent) == brute_components(rows, size, percent)


def test_large_groups_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 600)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(8)
    texts = [t for t in family(rng, 50, 100, 8)]
    assert near(as_docs(spark, texts), 3, 85) == brute_components(list(enumerate(texts)), 3, 85)


def test_near_duplicates_of_odd_documents(odd_docs, odd_texts, no_docs, spark):
    assert near(odd_docs, 3, 85) == brute_components(list(enumerate(odd_texts)), 3, 85)
    assert neardup.near_duplicates(no_docs).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None), (2, "z")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [
        ("2", "2", True), ("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "4", False),
        ("None", "None", True)]


def test_one_document_of_each_group_stays(odd_docs, odd_texts):
    kept = neardup.drop_near_duplicates(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns
    want = sorted(i for i, _, _, stays in brute_components(list(enumerate(odd_texts)), 3, 85) if stays)
    assert sorted(r.doc_id for r in kept.collect()) == want
    twice = neardup.drop_near_duplicates(odd_docs.unionAll(odd_docs), 3, 85)
    assert sorted(r.doc_id for r in twice.collect()) == want


def test_any_pair_with_few_errors_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, neardup.N)).astype(np.uint16)
    b = a.copy()
    for i in range(len(b)):
        wrong = rng.choice(neardup.N, 2 * neardup.CHUNKS - 1, replace=False)
        b[i, wrong] ^= 1
    x, y = neardup.chunk_keys(a), neardup.chunk_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    assert not set(x[0].tolist()) & set(x[1].tolist())


def linked(spark, sig):
    """The component of every signature (by row) that near_links links."""
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "node long, sig binary")
    return dict(tuple(r) for r in components(neardup.near_links(nodes)).collect())


def check_links(spark, sig):
    """All pairs within REACH that share a key are in one component; returns their number."""
    part, keys = linked(spark, sig), [set(k) for k in neardup.chunk_keys(sig).tolist()]
    pairs = [(i, int(j)) for i in range(len(sig)) for j in np.flatnonzero((sig[:i] != sig[i]).sum(axis=1) <= neardup.REACH)
             if keys[i] & keys[j]]
    assert all(part.get(i, i) == part.get(j, j) for i, j in pairs)
    return len(pairs)


def test_far_leaders_of_all_keys_part_no_pair(spark):
    rng = np.random.default_rng(4)
    pair = rng.integers(0, 1 << 16, (2, neardup.N)).astype(np.uint16)
    pair[1] = pair[0]
    pair[1, ::neardup.SIZE] ^= 1  # an error in each chunk: a key in each is shared
    # for every chunk a smaller node that is unlike the pair but for these symbols
    unlike = rng.integers(0, 1 << 16, (neardup.CHUNKS, neardup.N)).astype(np.uint16)
    for c in range(neardup.CHUNKS):
        at = slice(c * neardup.SIZE + 1, (c + 1) * neardup.SIZE)
        unlike[c, at] = pair[0, at]
    assert check_links(spark, np.concatenate([unlike, pair])) == 1


@pytest.mark.parametrize("crowd", [1, 6])
def test_crowded_keys_are_split(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rng = np.random.default_rng(crowd)
    # most documents share a few symbols with all others, and few are alike
    common = rng.integers(0, 1 << 16, neardup.N)
    base = np.where(rng.random((60, neardup.N)) < 0.45, common, rng.integers(0, 1 << 16, (60, neardup.N)))
    alike = np.where(rng.random((60, neardup.N)) < 0.75, base, rng.integers(0, 1 << 16, (60, neardup.N)))
    sig = rng.permutation(np.concatenate([base, alike])).astype(np.uint16)
    assert check_links(spark, sig) > 40


def test_further_keys_of_all_pairs_within_reach():
    rng = np.random.default_rng(3)
    key = np.zeros(100, np.uint64)
    for used in (0b1, 0b1000_0000_0010, 0b1110_0000_0000, 0b1111_1000_0000):
        a = rng.integers(0, 1 << 16, (100, neardup.N)).astype(np.uint16)
        b = a.copy()
        free = [i for i in range(neardup.N) if not used >> i // neardup.SIZE & 1]
        for i in range(len(b)):
            b[i, rng.choice(free, neardup.REACH, replace=False)] ^= 1
        (x, chunks), (y, _) = neardup.split_keys(key, a, used), neardup.split_keys(key, b, used)
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
        assert all(c & used == used and c.bit_count() == used.bit_count() + 1 for c in chunks.tolist())


def test_near_duplicates_among_documents_of_shared_lines(spark):
    rng = random.Random(12)
    lines = [" ".join(f"l{rng.randrange(10 ** 6)}" for _ in range(8)) for _ in range(24)]
    texts = []
    for i in range(1200):
        own = rng.sample(lines, 10)
        texts.append("\n".join(own))
        if i % 12 == 0:
            own[rng.randrange(10)] = f"only {rng.randrange(10 ** 6)}"
            texts.append("\n".join(own))
    rng.shuffle(texts)
    assert near(as_docs(spark, texts), 5, 80) == brute_components(list(enumerate(texts)), 5, 80)


@pytest.mark.parametrize("seed", range(10))
def test_linking_sets(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 20)).astype(np.uint64)]))
            for _ in range(25)]
    links = neardup.link_sets(sets, list(range(25)), 60)
    root = list(range(25))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in links:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both)
        assert find(i) != find(j)
        root[find(i)] = find(j)
    for i in range(25):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                assert find(i) == find(j)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -------------------------------------------------------------- exact search


def brute_top(rows, k, every):
    ok = [(n, i, np.floor(64 * np.array(v, float))) for n, (i, v) in enumerate(rows)
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for n, i, q in ok:
        if i % every == 0:
            scores = sorted((-int(q[:len(v)] @ v[:len(q)]), j) for m, j, v in ok if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def top(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k).collect())


def test_search_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # many equal vectors: ties
    rows += [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7),
             (None, [1.0] * 8), (480, []), (500, [0.0] * 8), (520, [1.0]), (0, rows[0][1]), (540, [-9.0] * 8)]
    assert top(spark, rows, 20, 20) == brute_top(rows, 20, 20)
    assert top(spark, rows[:5], 20, 1) == brute_top(rows[:5], 20, 1)
    assert top(spark, [(400, None)], 20, 20) == []


def test_search_with_many_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * rng.lognormal(0, 1.5)).astype(np.float32).tolist()) for i in range(3000)]
    assert top(spark, rows, 20, 100) == brute_top(rows, 20, 100)


@pytest.mark.parametrize("seed", range(5))
def test_pruning_keeps_all_that_reach_the_bound(seed):
    rng = np.random.default_rng(seed)

    def block(n, around):
        items = np.floor(64 * (around + 0.1 * rng.normal(size=(n, 6))))
        length = np.sqrt((items ** 2).sum(axis=1))
        by = np.argsort(-length)
        ids = np.arange(n)
        return topk.Block(ids.tobytes(), (ids + 10 ** 6 * seed).tobytes(), length[by].tobytes(), items[by].tobytes())

    around = rng.normal(size=6)
    q, b = block(20, around), block(500, around)
    q.rows = -q.rows - 1
    exact = q.items @ b.items.T
    bound = np.sort(exact, axis=1)[:, -20]  # high: coordinates prune
    assert (bound / (q.lengths * b.lengths[0]) >= topk.COSINE).any()
    for i, (at, score) in enumerate(topk.search(q, b, bound, 20)):
        want = np.flatnonzero(exact[i] >= bound[i])
        assert at.tolist() == want.tolist() and score.tolist() == exact[i][want].tolist()
