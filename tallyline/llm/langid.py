"""Hierarchical language identification: the family first, then pairs within the family.

Texts become hashed counts of byte bigrams and trigrams. One linear SVM per family (against
the rest) chooses the family; inside it a linear SVM for every two languages votes for one
of them. The classifiers learn from at most ``TRAINING`` labelled texts, spread evenly over
the languages and chosen by a hash; texts are predicted whole, and from the text alone.

Defined results: null text and text without a letter are ``und`` with score 0, as is every
text if nothing can be learned; texts with a null language are not learned from; repeated
rows are predicted alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

TRAINING = 2400
#: texts whose vectors are held at once
AT_ONCE = 1024
BITS = 12
WIDTH = 1 << BITS
UNKNOWN = "und"

#: fixed values: families of closely related languages; a language not listed stands alone
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted n-gram counts, one row per text."""
    n = len(at) - 1
    low = _FOLD[data]
    # capitals of the Latin-1 block: C3 80 to C3 9E
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    owner = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(at))
    total = np.zeros(n * WIDTH, np.float32)
    two = low[:-1] << np.uint32(8) | low[1:]
    three = two[:-1] << np.uint32(8) | low[2:]
    for gram, reach in ((two, 1), (three, 2)):
        same = owner[:-reach] == owner[reach:]
        code = (gram * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)
        total += np.bincount((owner[:-reach] + code)[same], minlength=n * WIDTH)
    out = np.sqrt(total).reshape(n, WIDTH)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _vectors(docs: DataFrame, *names: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text", rows=AT_ONCE):
            x = features(data, at).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(len(names))], pa.array([v.tobytes() for v in x], pa.binary())],
                [*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, "lang string, x binary")


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Linear SVM with squared hinge loss, classes weighed alike; the last weight is the bias."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    b = 0.0
    ahead_w, ahead_b = w.copy(), b
    step = 0.2  # the loss has curvature of at most 2 * (|x|^2 + 1) = 4 here
    for i in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead_w + ahead_b))
        pull = -2 * share * short * y
        new_w, new_b = ahead_w - step * (x.T @ pull + penalty * ahead_w), ahead_b - step * float(pull.sum())
        momentum = i / (i + 3)
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return np.append(w, np.float32(b))


class Model:
    """Families, languages, and one weight column per classifier."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        names = sorted(set(langs))
        family = np.array([family_of(v) for v in langs])
        self.families = sorted(set(family))
        self.members = [[v for v in names if family_of(v) == f] for f in self.families]
        weights, self.pairs = [], []
        for f in self.families:
            if len(self.families) > 1:
                weights.append(train_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)))
        for f, members in enumerate(self.members):
            for a, b in itertools.combinations(range(len(members)), 2):
                some = (langs == members[a]) | (langs == members[b])
                y = np.where(langs[some] == members[a], 1.0, -1.0).astype(np.float32)
                self.pairs.append((f, a, b))
                weights.append(train_svm(x[some], y))
        self.weights = np.array(weights, np.float32).reshape(-1, WIDTH + 1).T

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.families) if len(self.families) > 1 else 0
        margin = x @ self.weights[:-1] + self.weights[-1]
        likely = 1 / (1 + np.exp(-4 * margin))
        family = margin[:, :k].argmax(axis=1) if k else np.zeros(n, np.int64)
        score = likely[np.arange(n), family] if k else np.ones(n)
        out = np.empty(n, object)
        for f, members in enumerate(self.members):
            mine = np.flatnonzero(family == f)
            won, sure = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
            for p, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m, chance = margin[mine, k + p], likely[mine, k + p]
                    won[:, a] += m >= 0
                    won[:, b] += m < 0
                    sure[:, a] += chance
                    sure[:, b] += 1 - chance
            # most votes; ties by the sum of probabilities
            pick = (won + sure / (len(members) + 1)).argmax(axis=1)
            out[mine] = np.array(members, object)[pick]
            if len(members) > 1:
                score[mine] *= sure[np.arange(len(mine)), pick] / (len(members) - 1)
        return out, np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """One third of all documents is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, training: int = TRAINING) -> Model | None:
    """Fit on a bounded sample of labelled documents that are not held out."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    each = max(1, training // len(counts))
    order = F.xxhash64("doc_id")
    # a draw a little larger than the share, then exactly the share
    unit = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(1.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, (1.2 * each + 50) / r["n"])).otherwise(share)
    drawn = usable.where(unit < share).withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy(order, F.xxhash64("text")))).where(F.col("nth") <= each)
    rows = _vectors(drawn.select("lang", "text"), "lang").toArrow()
    # the order of rows must not matter
    sample = sorted(zip(rows["lang"].to_pylist(), rows["x"].to_pylist()))
    x = np.frombuffer(b"".join(v for _, v in sample), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Model(x, np.array([lang for lang, _ in sample], object))


def _has_letter(rows: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in rows[int(i)].as_py() or "")
    return out


def identify(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """``lang_pred`` and ``score`` of every document, beside the columns named in ``carry``."""
    # a text that is carried is sent once
    text = "text" if "text" in carry else "_text"
    kept = docs.select(*carry, *([] if text in carry else [F.col("text").alias(text)]))
    at_text = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by languages and WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, text, rows=AT_ONCE):
            n = rows.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if sent.value is not None:
                known = _has_letter(rows.column(at_text), data, at)
                got, sure = sent.value.predict(features(data, at))
                lang[known], score[known] = got[known], sure[known]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(n_carry)], pa.array(lang.tolist(), pa.string()),
                 pa.array(score.astype(np.float64))], [*carry, "lang_pred", "score"])

    n_carry = len(carry)
    schema = kept.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)


def set_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """Documents with ``lang`` as predicted; those without a language go, other columns stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    told = identify(docs.select(row.alias("row"), "text"), model, "row", "text").where(F.col("lang_pred") != UNKNOWN)
    return told.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("text") if c == "text"
                         else F.col(f"row.`{c}`") for c in docs.columns])


def identify_documents(docs: DataFrame) -> DataFrame:
    named = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(named, learn(docs), "doc_id", "held_out")
