"""SimHash, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import as_docs

from tallyline.llm import merkle, pii, simhash, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    """Smallest item reachable, item by item."""
    items = sorted(items)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(items):
        for b in items[:k]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def test_fingerprints_and_components(spark, odd_docs, odd_texts):
    rows = {r.doc_id: r for r in simhash.group_documents(odd_docs).collect()}
    want = {i: brute_fingerprint(t) for i, t in enumerate(odd_texts)}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == want
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows.values())
    parts = brute_components(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in rows.items()} == parts
    assert rows[15].component_id == 0  # texts without a word link


def test_fingerprints_of_documents(spark, docs):
    some = docs.toPandas()
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in zip(some.doc_id, some.text)}


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_shingles_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for n in range(9):
        raw = b" " + b"\n ".join(b"W%d" % i for i in range(n)) + b"\t"
        words = raw.lower().split()
        for size in (1, 2, 3):
            want = [b" ".join(words[i:i + size]) for i in range(n - size + 1)] or ([b" ".join(words)] if n else [])
            assert [s for lot in simhash.shingles(raw, size) for s in lot] == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def partition(pairs, items):
    """Groups that links make, whichever links these are."""
    parts = {i: {i} for i in items}
    for a, b in pairs:
        if parts[a] is not parts[b]:
            parts[a] |= parts[b]
            for x in parts[b]:
                parts[x] = parts[a]
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("crowd", [2, 2048])
def test_links_hold_together_what_is_near(spark, monkeypatch, crowd):
    rng = random.Random(crowd)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    found = {0, (1 << 64) - 1}
    for _ in range(6):  # clusters of fingerprints whose differences lie anywhere, or in few bits
        base, bits = rng.getrandbits(64), rng.sample(range(64), rng.choice([6, 12, 64]))
        for _ in range(25):
            found.add(base ^ sum(1 << b for b in rng.sample(bits, rng.randrange(5))))
    found = sorted(found)
    table = spark.createDataFrame([(signed(f),) for f in found], "fp long")
    links = simhash.near_fingerprints(table).collect()
    links = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in links]
    near = [(a, b) for a in found for b in found if a < b and (a ^ b).bit_count() <= 2]
    assert partition(links, found) == partition(near, found)


def test_crowded_keys_are_cut_and_end(spark, monkeypatch):
    """All fingerprints of 10 free bits: keys of all sizes, every one linked to the others."""
    monkeypatch.setattr(simhash, "CROWD", 100)
    bits = list(range(0, 20, 2))
    base = random.Random(1).getrandbits(64)
    found = [base ^ sum(1 << b for k, b in enumerate(bits) if i >> k & 1) for i in range(1 << 10)]
    table = spark.createDataFrame([(signed(f),) for f in found], "fp long")
    links = simhash.near_fingerprints(table).distinct().collect()
    assert len(partition([(r.u, r.v) for r in links], [signed(f) for f in found])) == 1


def test_simhash_of_no_rows_and_null_ids(spark, no_docs):
    assert simhash.group_documents(no_docs).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (3, "A B C"), (3, "a b c"), (None, "d")], "doc_id long, text string")
    out = simhash.group_documents(rows).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == {(None, 3): 1, (3, 3): 2, (None, None): 1}


# ---------------------------------------------------------------- spelling


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(n):
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b and spelling_distance_is_one(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelling_distance_is_one(a, b):
    """By the whole table of edit distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters", [8192, 12])
def test_variants_of_words(spark, monkeypatch, letters):
    rng = random.Random(5)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
    n = {}
    for base in ("strasse", "ocean", "Éclairs", "zzzzzz", "aaaaaa", "queueing", "x" * 300, "ab" * 200):
        for _ in range(20):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k:k + rng.randrange(2)] = rng.choice(["", "a", "e", "s", "ß", "É", "ÿ", "÷", "z"])
            if len(w) >= 6:
                n["".join(w)] = rng.choice([5, 6, 25, 30, 125, 700, 4000])
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.variants(table).collect()
    assert len(got) == len(n)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(n)


def test_spellings_of_documents(spark, docs, odd_docs, odd_texts, no_docs):
    pdf = docs.toPandas()
    assert as_rows(spelling.vocabulary(docs).withColumnsRenamed({}).selectExpr(
        "word", "'' AS form", "'' AS root", "n", "0 AS n_near", "0 AS form_n")) == {
            (w, "", "", c, 0, 0) for w, c in brute_words(zip(pdf.doc_id, pdf.text)).items()}
    texts = odd_texts + ["Wörter wörter WÖRTER straße"] * 8 + ["a" * 70_000] * 6
    many = as_docs(spark, texts)
    assert as_rows(spelling.group_spellings(many)) == brute_variants(brute_words(enumerate(texts)))
    assert spelling.group_spellings(no_docs).count() == 0


def test_long_chains_reach_their_root(spark):
    words = [("b" * k + "a" * (26 - k), 5 ** (k + 1)) for k in range(26)]
    got = spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.root for r in got} == {words[-1][0]}


def test_chains_are_as_long_as_counts_allow(spark):
    words = [(f"{'a' * k}{'b' * (9 - k)}", 5 ** (k + 1)) for k in range(10)]
    assert as_rows(spelling.variants(spark.createDataFrame(words, "word string, n long"))) == brute_variants(dict(words))


# ---------------------------------------------------------------- merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(hashes, arity):
    """Root, and for each leaf the pairs of what stands left and right, level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            first = i - i % arity
            paths[k].append((hashes[first:i], hashes[i + 1:first + arity]))
        hashes = [sha(*hashes[i:i + arity]) for i in range(0, len(hashes), arity)]
        at = [i // arity for i in at]
    return hashes[0], paths


def brute_manifest(rows, arity=16):
    trees = defaultdict(list)
    for r in rows:
        leaf = brute_leaf(r, r.text)
        low = r.text and r.text.translate(LOW)
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        trees[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf, brute_leaf(r, low) if tampered else None, r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: brute_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], arity) for s in names}
    root, tops = brute_tree([sub[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, tampered, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), sub[s][1]):
            now = tampered or leaf
            for left, right in path + top:
                now = sha(*left, now, *right)
            proof = sha(*[h for left, right in path + top for h in left + right])
            out.append((r.doc_id, leaf, sub[s][0], root, proof, now, now == root))
    return sorted(out, key=str)


def as_proofs(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("arity", [2, 16])
def test_manifest(spark, docs, arity):
    assert as_proofs(merkle.prove_documents(docs, arity)) == brute_manifest(docs.collect(), arity)


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.unionByName(odd_docs.limit(4)).unionByName(odd_docs.limit(3).selectExpr(
        "CAST(NULL AS long) AS doc_id", *[f"`{c}`" for c in odd_docs.columns[1:]]))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert as_proofs(merkle.prove_documents(rows)) == brute_manifest(rows.collect())
    assert merkle.prove_documents(no_docs).count() == 0


def test_manifest_of_one_row(spark):
    row = as_docs(spark, ["Text"])
    assert as_proofs(merkle.prove_documents(row)) == brute_manifest(row.collect())


@pytest.mark.parametrize("n", [16, 257])
def test_one_tree_of_many_sizes(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "1 AS n_chars", "'T' AS text")
    assert as_proofs(merkle.prove_documents(rows)) == brute_manifest(rows.collect())


def test_levels_share_one_exchange(spark):
    """Siblings meet, are grouped and join their parents' paths without a further exchange."""
    nodes = spark.range(64).selectExpr("CAST(id % 3 AS string) AS tree", "id AS i", "64L AS n", "sha2(CAST(id AS string), 256) AS h")
    dealt = merkle._dealt(nodes, 16)
    with merkle._together(spark):
        plan = merkle._siblings(dealt, dealt, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_numbers_follow_the_order(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{int(t)}", int(x)) for t, x in zip(rng.integers(0, 3, 500), rng.integers(0, 90, 500))]
    table = spark.createDataFrame(rows, "tree string, x int").repartition(7)
    got = merkle.numbered(table, "tree", ["x"]).collect()
    for name in {t for t, _ in rows}:
        mine = sorted((r.i, r.x, r.n) for r in got if r.tree == name)
        assert [i for i, _, _ in mine] == list(range(len(mine)))
        assert [x for _, x, _ in mine] == sorted(x for t, x in rows if t == name)
        assert {k for _, _, k in mine} == {len(mine)}



# ---------------------------------------------------------------- personal data


class Sure:
    """A model that takes every candidate."""

    thresholds = np.zeros(4)

    @staticmethod
    def trees(x):
        return x[:, 1] / 1000  # longer ones first


def brute_added(text, base):
    out = []
    for s in sorted(pii.candidates(text), key=lambda s: (-(s[2] - s[0]), s)):
        if not any(s[0] < o[2] and o[0] < s[2] for o in [*base, *out]):
            out.append(s)
    return sorted(out)


def test_addresses_with_thousands_of_zeros():
    for zeros in (3, 5000):
        text = "0" * zeros + ".1.1.1 and 256.1.1.1"
        assert pii.base_spans(text) == [(0, 1, zeros + 6)]


def test_added_spans_stay_apart():
    rng = random.Random(8)
    parts = ["a@b", "me@x.example", "10.0.0.300.7", "1.2.3.4", "4111 1111 1111 1111", "(555) 555-0100", "+1 555 555 0100",
             "12345678901234567890", "x", "@", ".", "-"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", ", "]) for _ in range(30))
        base = pii.base_spans(text)
        assert pii.added_spans([text], [base], Sure) == [brute_added(text, base)]


def test_a_long_text_of_candidates_takes_linear_time():
    text = "10.0.0.300.7 call (555) 555-0100 or 4111.1111.1111.1112 " * 20_000
    start = time.time()
    base = pii.base_spans(text)
    added, = pii.added_spans([text], [base], Sure)
    assert len(added) >= 40_000 and time.time() - start < 40
