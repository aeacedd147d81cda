"""Personal data by candidate spans and gradient-boosted trees.

Patterns with checks (parts, digits, Luhn) give the base spans, which always stay. Wider
generators propose candidates of the same kinds: digits in groups, dotted numbers, anything
around an ``@``. What makes a base span valid is hidden from the trees (the plus sign, the
check digit, the range of the parts, the dots of a domain); they see a candidate's format
and its context and learn how often candidates of that look are valid. Of the candidates
that touch no base span, those above a threshold are added: for each kind, the lowest at
which the candidates held back from training reach ``PRECISION``.

The trees learn from the candidates of at most about ``TRAINING`` documents, chosen by a
hash of doc_id and text. The thresholds come from all candidates of all other documents
(those with a text that was trained on left out), counted by kind and score in ``BINS``
steps; however few candidates a kind has, their share counts as it is. All documents are
searched, as whole texts.

Defined results: null or empty text has no spans; positions are code points, ends
exclusive; of added spans that overlap the likelier stays, then the earlier; repeated rows
get the same spans; a kind without held-back candidates is not added to; without candidates to train on all
score 0.5; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
TRAINING = 20_000
#: of one document's candidates so many, chosen by a hash, are learned from
PER_DOCUMENT = 50
PRECISION = 0.98
BINS = 1 << 12

Span = tuple[int, int]

# -------------------------------------------------------------- base spans

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match that fails from the start of a run of digits fails from inside it, too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Around every ``@``: the local part before it, not reaching into the last match."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > past and _LOCAL.match(text[lo - 1]):
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            out.append((lo, domain.end()))
            past = domain.end()
        else:
            past = at + 1  # no local part reaches across an @
        at = text.find("@", past)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, ordered."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            # a part may have thousands of leading zeros
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _DIGITS.findall(m[0]) if m.end() - m.start() >= 14 else ()
            if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# -------------------------------------------------------------- candidates

_WIDE = (
    (0, re.compile(r"[^\s@]{1,64}@[^\s@]{1,255}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){2,5}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,23}(?![0-9])")),
    (3, re.compile(r"\(?(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,16}(?![0-9])")),
)
#: a candidate is valid if a base span of its kind covers the same characters, but for these
_EDGE = "+()[]<>{}.,;:!?\"'*#$%& "


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that looks a little like personal data."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _WIDE[0][1].finditer(text)]
    if _DIGITS.search(text):
        for kind, pattern in _WIDE[1:]:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    trimmed = []
    for a, kind, b in out:
        while a < b and text[a] in _EDGE and text[a] not in "(":
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b > a:
            trimmed.append((a, kind, b))
    return sorted(set(trimmed))


_RUN = re.compile(r"[0-9]+")


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a candidate; nothing that a base check looks at."""
    a, kind, b = span
    said = text[a:b]
    runs = [m.end() - m.start() for m in _RUN.finditer(said)]
    digits = sum(runs)
    letters = sum(c.isalpha() for c in said)
    before, after = text[max(0, a - 24):a].rstrip("+("), text[b:b + 24]
    last = before.split()[-1:] or [""]
    near = before + after
    return [
        kind, b - a, digits, letters, b - a - digits - letters, len(runs), max(runs, default=0),
        min(runs, default=0), runs[-1] if runs else 0, len(set(said)), said.count(" "), said.count("-"),
        sum(c.isupper() for c in said), float(before[-1:].isspace() or not before),
        float(before[-1:].isalnum()), float(after[:1].isspace() or not after), float(after[:1].isalnum()),
        sum(c.isdigit() for c in near), sum(not c.isalnum() and not c.isspace() for c in near),
        float(last[0].isalpha()), len(last[0]), float(last[0][-1:] in "=:#\""),
    ]


def _bare(text: str, a: int, b: int) -> Span:
    while a < b and text[a] in _EDGE:
        a += 1
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def examples(text: str, most: int | None = None) -> list[tuple[list[float], bool]]:
    """Described candidates, at most so many, and whether each is a base span of its kind."""
    valid = {(k, *_bare(text, a, b)) for a, k, b in base_spans(text)}
    found = candidates(text)
    if most is not None and len(found) > most:
        found.sort(key=lambda s: hashlib.md5(repr((s, text[s[0]:s[2]])).encode()).digest())
        found = found[:most]
    # a phone's country code is part of the base span, not of every candidate
    return [(describe(text, s), (s[1], *_bare(text, s[0], s[2])) in valid) for s in found]


# ------------------------------------------------------------------- trees


@dataclass
class Tree:
    """A tree of fixed depth: node i goes to 2i + 1 (value <= cut) or 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.leaf).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.leaf[at - len(self.feature)]


class Boosted:
    """Gradient boosting of the log loss over histograms of each feature's values."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 5.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(f, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in x.T]
        codes = np.stack([np.searchsorted(c, f) for c, f in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, cuts, y - p, p * (1 - p))
            score += tree(x)
            self.trees.append(tree)
        return self

    def _grow(self, codes: np.ndarray, cuts: list[np.ndarray], pull: np.ndarray, weight: np.ndarray) -> Tree:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(pull), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            for f, c in enumerate(cuts if len(mine) else []):
                g = np.cumsum(np.bincount(codes[mine, f], pull[mine], len(c) + 1))
                h = np.cumsum(np.bincount(codes[mine, f], weight[mine], len(c) + 1))
                left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
                gain = np.where((left_h > 0.01) & (right_h > 0.01), left_g ** 2 / (left_h + self.least)
                                + right_g ** 2 / (right_h + self.least) - g[-1] ** 2 / (h[-1] + self.least), 0)
                if len(gain) and gain.max() > best:
                    best = gain.max()
                    feature[node], cut[node] = f, c[gain.argmax()]
            side = np.isfinite(cut[node]) * (codes[mine, feature[node]] > np.searchsorted(
                cuts[feature[node]], cut[node]))
            at[mine] = 2 * node + 1 + side
        g = np.bincount(at - inner, pull, inner + 1)
        h = np.bincount(at - inner, weight, inner + 1)
        return Tree(feature, cut, self.rate * g / (h + self.least))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum((t(x) for t in self.trees), np.zeros(len(x))))))


@dataclass
class Model:
    trees: Boosted
    thresholds: np.ndarray


def tally(likely: np.ndarray, valid: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Candidates, and valid ones, by kind and score."""
    at = kind * BINS + np.minimum((likely * BINS).astype(np.int64), BINS - 1)
    n = len(KINDS) * BINS
    return np.stack([np.bincount(at, minlength=n), np.bincount(at[valid > 0], minlength=n)]).reshape(2, len(KINDS), BINS)


def thresholds(counts: np.ndarray, precision: float) -> np.ndarray:
    """Per kind the lowest threshold whose candidates are valid often enough."""
    total, right = np.cumsum(counts[:, :, ::-1], axis=2)[:, :, ::-1]
    out = np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        good = np.flatnonzero((right[k] >= precision * total[k]) & (counts[0, k] > 0))
        if len(good):
            out[k] = good[0] / BINS
    return out


def calibrate(likely: np.ndarray, valid: np.ndarray, kind: np.ndarray, precision: float) -> np.ndarray:
    """Thresholds from candidates at hand."""
    return thresholds(tally(likely, valid, kind), precision)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _mark(text: str) -> int:
    return int.from_bytes(_digest(text)[8:], "little", signed=True)


def _held_back(docs: DataFrame, trees: Boosted, trained: frozenset[int]) -> np.ndarray:
    """The tally of all candidates in documents whose text was not trained on."""
    sent = docs.sparkSession.sparkContext.broadcast((trees, trained))  # marks of TRAINING documents at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, trained = sent.value
        counts = np.zeros((2, len(KINDS), BINS), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                found = [e for t in batch.column(0).slice(lo, 512).to_pylist() if _mark(t) not in trained
                         for e in examples(t)]
                if found:
                    x = np.array([f[0] for f in found])
                    counts += tally(trees(x), np.array([f[1] for f in found]), x[:, 0].astype(np.int64))
        kind, step = np.nonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(step, pa.int32()), pa.array(counts[0, kind, step]),
             pa.array(counts[1, kind, step])], ["kind", "step", "n", "n_valid"])

    rows = (docs.where(F.col("text").isNotNull()).select("text")
            .mapInArrow(run, "kind int, step int, n long, n_valid long")
            .groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("n_valid").alias("n_valid")).collect())
    counts = np.zeros((2, len(KINDS), BINS), np.int64)
    for r in rows:
        counts[:, r["kind"], r["step"]] = r["n"], r["n_valid"]
    return counts


def learn(docs: DataFrame, training: int = TRAINING) -> Model:
    """Fit trees on the candidates of a bounded sample of documents, thresholds on those of all others."""
    total = docs.count()
    key = F.xxhash64("doc_id", "text")
    share = min(1.0, training / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_mark(t), x, v) for t in batch.column(0).to_pylist() if _digest(t)[0] % 2 == 0
                    for x, v in examples(t, PER_DOCUMENT)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[2] for r in rows], pa.bool_())], ["mark", "x", "valid"])

    drawn = docs.where(F.col("text").isNotNull() & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = drawn.select("text").mapInArrow(run, "mark long, x array<double>, valid boolean").toArrow()
    trees = Boosted()
    if rows.num_rows:
        x, valid = np.array(rows["x"].to_pylist()), np.array(rows["valid"].to_pylist())
        order = np.lexsort(x.T)  # the order of rows must not matter
        trees.fit(x[order], valid[order].astype(float))
    counts = _held_back(docs, trees, frozenset(rows["mark"].to_pylist()))
    return Model(trees, thresholds(counts, PRECISION))


class _Covered:
    """Whether a span meets one of the sorted spans, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s[0] for s in spans]
        self.ends = list(accumulate((s[2] for s in spans), max))  # the furthest end so far

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


class _Chosen:
    """Spans apart from each other, in order; a new one can only meet its neighbours."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []

    def add(self, span: tuple[int, int, int]) -> None:
        i = bisect_left(self.spans, span)
        apart = (i == 0 or self.spans[i - 1][2] <= span[0]) and (
            i == len(self.spans) or span[2] <= self.spans[i][0])
        if apart:
            self.spans.insert(i, span)


def added_spans(texts: list[str], base: list[list[tuple]], model: Model) -> list[list[tuple[int, int, int]]]:
    """For every text the candidates the model adds to its base spans, likeliest first where they overlap."""
    where, spans, rows, lots = [], [], [], []
    for i, text in enumerate(texts):
        covered = _Covered(base[i])
        for s in candidates(text):
            if not covered.meets(s[0], s[2]):
                where.append(i)
                spans.append(s)
                rows.append(describe(text, s))
                if len(rows) == 4096:  # as arrays they take a fraction of the memory
                    lots.append(np.array(rows))
                    rows = []
    if rows:
        lots.append(np.array(rows))
    out = [_Chosen() for _ in texts]
    if lots:
        x = np.concatenate(lots)
        likely = model.trees(x)
        chosen = np.flatnonzero(likely >= model.thresholds[x[:, 0].astype(int)])
        for j in sorted(chosen.tolist(), key=lambda j: (-likely[j], spans[j])):
            out[where[j]].add(spans[j])
    return [o.spans for o in out]


def find(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """``spans`` of every document: (start, end, kind, base), beside the columns in ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen small trees
    kept = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text"))
    n_carry = len(carry)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = rows.column(n_carry).to_pylist()
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, sent.value) if sent.value else [[] for _ in texts]
                spans = [[{"start": a, "end": b, "kind": KINDS[k], "base": own} for a, k, b, own in
                          sorted([(*s, True) for s in one] + [(*s, False) for s in two])]
                         for one, two in zip(base, more)]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(i) for i in range(n_carry)], pa.array(spans, kind)], [*carry, "spans"])

    span = T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("base", "boolean")
    schema = kept.drop("_text").schema.add("spans", T.ArrayType(span))
    return kept.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their checksum, and all spans as one string."""
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def find_in_documents(docs: DataFrame) -> DataFrame:
    return digest(find(docs, learn(docs), "doc_id"))


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap give their characters once."""
    out, past = [], 0
    for a, kind, b in sorted(spans):
        if a >= past:
            out += [text[past:a], f"<{KINDS[kind]}>"]
        past = max(past, b)
    return "".join(out) + text[past:]


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """Documents with personal data replaced; all other columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                given = rows.column(1).to_pylist()
                texts = [t or "" for t in given]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, sent.value) if sent.value else [[] for _ in texts]
                new = [g if g is None else replace(t, one + two)
                       for g, t, one, two in zip(given, texts, base, more)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(new, pa.string())], ["row", "text"])

    done = packed.mapInArrow(run, packed.schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
