"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule calls a document good, bad, or abstains. The votes of a document are one pattern,
a number of base 3; patterns are counted over all documents (at most 3 ** rules of them, so
the counts may come to the driver) and expectation-maximisation estimates, without labels,
how each rule votes on good and on bad documents. A document is kept if its posterior
probability of being good reaches the threshold; no single rule decides.

Defined results: null text has no words and fails the base rules; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, keep, mix64, shingle_hashes, span_hashes, word_bounds

WINDOW = 5
ABSTAIN, GOOD, BAD = 0, 1, 2
_SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT, _END = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SHOUT[list(b"!?")] = True
_END[list(b".!?:;\"')")] = True


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64)


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text of a block, each over the whole text."""
    n = len(at) - 1
    starts, ends, first = word_bounds(data, at)
    n_words = np.diff(first)
    words = span_hashes(data, starts, ends)
    head = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    owner = np.repeat(np.arange(n), n_words)
    out = {"n_words": n_words, "word_chars": _per_text(points[ends] - points[starts], owner, n),
           "n_symbols": _sums(_SYMBOL[data], at), "upper": _sums(_UPPER[data], at),
           "lower": _sums(_LOWER[data], at), "digits": _sums(_DIGIT[data], at),
           "shouts": _sums(_SHOUT[data], at), "wide": _sums(data >= 0xC0, at)}
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] | _LOWER[data] | (data >= 0x80), dtype=np.int64)])
    out["lettered"] = _per_text(letters[ends] > letters[starts], owner, n)

    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out["stutters"] = _per_text(same, owner[1:], n)

    # windows of words that stand twice or more in their text
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(5))
    windows = shingle_hashes(words, WINDOW)
    inside = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[1:][owner[:len(windows)]])
    _, which, times = np.unique(windows[inside] ^ salt[owner[inside]], return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    twice = inside[times[which] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, owner, n)

    # lines: from a text's start or behind a line feed
    feeds = np.flatnonzero(data == 10)
    opens = np.concatenate([at[:-1], feeds + 1])
    line_owner = np.concatenate([np.arange(n), np.searchsorted(at, feeds, "right") - 1])
    order = np.lexsort((opens, line_owner))
    opens, line_owner = opens[order], line_owner[order]
    shuts = np.concatenate([opens[1:] - 1, [len(data)]])
    last = np.concatenate([line_owner[1:] != line_owner[:-1], [True]])
    shuts[last] = at[1:][line_owner[last]]
    worded = np.searchsorted(starts, shuts) > np.searchsorted(starts, opens)
    opens, shuts, line_owner = opens[worded], shuts[worded], line_owner[worded]
    lines = span_hashes(data, opens, shuts) ^ salt[line_owner]
    _, kinds = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_owner[kinds], minlength=n)
    ends_well = np.zeros(n, bool)
    full = n_words > 0
    ends_well[full] = _END[data[ends[first[1:][full] - 1] - 1]]
    out["ends_well"] = ends_well
    return out


def _between(value: np.ndarray, good: tuple[float, float], fair: tuple[float, float]) -> np.ndarray:
    """Good inside ``good``, bad outside ``fair``, else no vote."""
    vote = np.full(len(value), ABSTAIN)
    vote[(value >= good[0]) & (value <= good[1])] = GOOD
    vote[(value < fair[0]) | (value > fair[1])] = BAD
    return vote


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


_ANY = (-np.inf, np.inf)
Rule = Callable[[dict[str, np.ndarray]], np.ndarray]
RULES: dict[str, Rule] = {
    "length": lambda m: _between(m["n_words"], (50, np.inf), (10, np.inf)),
    "word length": lambda m: _between(_ratio(m["word_chars"], m["n_words"]), (3.5, 8), (2.5, 12)),
    "symbols": lambda m: _between(_ratio(m["n_symbols"], m["n_words"]), (0, 0.02), (0, 0.2)),
    "letters": lambda m: _between(_ratio(m["upper"] + m["lower"] + m["wide"], m["word_chars"] - m["digits"]), (0.9, 1), (0.75, 1)),
    "words": lambda m: _between(_ratio(m["lettered"], m["n_words"]), (0.95, 1), (0.85, 1)),
    "capitals": lambda m: _between(_ratio(m["upper"], m["upper"] + m["lower"]), (0, 0.15), (0, 0.4)),
    "digits": lambda m: _between(_ratio(m["digits"], m["word_chars"]), (0, 0.15), (0, 0.5)),
    "stutter": lambda m: _between(_ratio(m["stutters"], m["n_words"]), (0, 0.03), (0, 0.2)),
    "shouting": lambda m: _between(_ratio(m["shouts"], m["n_words"]), (0, 0.03), (0, 0.3)),
    "repeated lines": lambda m: _between(_ratio(m["n_dup_lines"], m["n_lines"]), (0, 0.1), (0, 0.3)),
    "repeated words": lambda m: _between(_ratio(m["n_repeat_words"], m["n_words"]), (0, 0.05), (0, 0.15)),
    "ending": lambda m: np.where(m["ends_well"], GOOD, ABSTAIN),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Base counts of every document and its pattern of votes, a base-3 number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, "text"):
            found = measures(data, at)
            pattern = np.zeros(rows.num_rows, np.int64)
            for i, rule in enumerate(rules.values()):
                pattern += 3 ** i * rule(found).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(found[c], pa.int64()) for c in _COUNTS], pa.array(pattern)],
                ["doc_id", *_COUNTS, "pattern"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", pattern long")


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Log odds (good against bad) of every rule's outcomes, and of the prior, by EM.

    ``votes`` has a row per pattern. To start with, each bad vote makes good quality less
    likely: kinds of junk differ, so most rules pass most junk, and a majority would miss it.
    Counts are smoothed by one vote each way, so a rule that never votes stays neutral.
    """
    m = votes.shape[1]
    good = 0.95 * 0.3 ** (votes == BAD).sum(axis=1)
    odds, prior = np.zeros((m, 3)), 0.0
    for _ in range(rounds):
        share = np.zeros((2, m, 3))
        for outcome in range(3):
            hit = (votes == outcome) * counts[:, None]
            share[0, :, outcome] = (hit * good[:, None]).sum(axis=0) + 1
            share[1, :, outcome] = (hit * (1 - good)[:, None]).sum(axis=0) + 1
        share /= share.sum(axis=2, keepdims=True)
        odds = np.log(share[0] / share[1])
        prior = float(np.log(((counts * good).sum() + 1) / ((counts * (1 - good)).sum() + 1)))
        # a rule may not turn its own vote around, and an abstention is a hint at most
        odds[:, ABSTAIN] = np.clip(odds[:, ABSTAIN], -1, 1)
        odds[:, GOOD], odds[:, BAD] = np.maximum(odds[:, GOOD], 0), np.minimum(odds[:, BAD], 0)
        new = 1 / (1 + np.exp(-np.clip(prior + odds[np.arange(m), votes].sum(axis=1), -50, 50)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return odds, prior


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Base counts, base verdict, posterior probability of good quality, and ``kept``."""
    voted = keep(vote(docs, rules))
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    seen.sort(key=lambda r: r["pattern"])
    codes = np.array([r["pattern"] for r in seen], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(rules)) % 3
    odds, prior = estimate(votes, np.array([r["n"] for r in seen], np.float64))
    total = F.lit(prior)
    for i in range(len(rules)):
        outcome = (F.floor(F.col("pattern") / 3 ** i) % 3).cast("int")
        total = total + F.element_at(F.array(*[F.lit(float(x)) for x in odds[i]]), outcome + 1)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    probability = 1 / (1 + F.exp(-total))
    return voted.select("doc_id", *_COUNTS, failed.alias("base_failed"),
                        (~failed & (probability >= threshold)).alias("kept"),
                        probability.alias("quality_probability"))
