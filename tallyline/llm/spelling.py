"""Spelling variants: Gram matrices of blocks of letter counts, then verified edits.

Words are counted in one aggregate. Two words one edit apart have letter counts at a squared
distance of one (a letter more) or two (a letter for another). Words are blocked by length
and by how many letters they take from each of a few sets: an edit moves a word at most one
step in one set, or one down and another up, so a block meets only blocks that are one edit away in
that sense. Each meeting is one product of two small NumPy matrices, which gives all squared
distances; what is within two is verified letter by letter. A crowded cell of the grid is cut
into blocks of bounded size, so a task never holds more than two blocks.

A word's form is its near word with the largest count, if that is ``RATIO`` times its own. Counts
grow by that factor along a chain, so its length is bounded by the largest count, and a few rounds of
pointer doubling reach every root.

Defined results: null text has no words; a null doc_id counts as the empty text in what picks
damaged occurrences; repeated rows count as often as they come; an empty table gives no words; ties
go to the smaller word in code-point order; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: shortest word and smallest count that take part, and how much larger a form's count must be
SHORTEST, RAREST, RATIO = 6, 5, 5
#: one of so many occurrences, picked by checksum, lose a code point
DAMAGED = 199
#: sets of letters that name a word's cell; what is in none of them is a set of its own
SETS = ("ao", "eu", "inr", "stl", "cdmp")
#: letters in one block, and in one row's arrays
BLOCK_LETTERS = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "À-ÿ"
#: letters counted apart: a to z, and what stands from C0 to FF
_LETTERS = 26 + 64


# ---------------------------------------------------------------- words


def occurrences(docs: DataFrame) -> DataFrame:
    """Words of all texts, one row each; picked ones lack a code point.

    A run too short for a word stays so without a code point, hence it is left out at once.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z{_ACCENTED}]{{{SHORTEST},}}"), F.lit(0))
    low = F.translate("run", _UPPER, _LOWER)
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("low"))
    at = (F.col("h") % F.length("low")).cast("int")
    less = F.concat(F.col("low").substr(F.lit(1), at), F.col("low").substr(at + 2, F.length("low")))
    return (docs.select("doc_id", F.explode(runs).alias("run"))
            .select("doc_id", low.alias("low")).withColumn("h", F.crc32(named.cast("binary")))
            .select(F.when(F.col("h") % DAMAGED == 0, less).otherwise(F.col("low")).alias("word")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``n``, of words long and frequent enough."""
    counted = occurrences(docs).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= SHORTEST) & (F.col("n") >= RAREST))


# ---------------------------------------------------------------- blocks


def _cell(word: Column) -> Column:
    """Letters in each set, then all others: they sum to the length."""
    length = F.length(word)
    inside = [length - F.length(F.translate(word, letters, "")) for letters in SETS]
    return F.array(*inside, length - sum(inside, F.lit(0)))


def _met(cell: Column) -> Column:
    """The cell itself, those with a letter more, and those with a letter of a later set for an earlier one.

    Every two cells an edit apart are met from one side.
    """
    n = len(SETS) + 1

    def moved(**step: int) -> Column:
        return F.array(*[cell[i] + step.get(f"_{i}", 0) for i in range(n)])

    longer = [moved(**{f"_{i}": 1}) for i in range(n)]
    traded = [moved(**{f"_{i}": -1, f"_{j}": 1}) for i in range(n) for j in range(i + 1, n)]
    return F.array(cell, *longer, *traded)


def _key(cell: Column) -> Column:
    return F.array_join(cell.cast("array<string>"), ",")


def blocked(words: DataFrame) -> DataFrame:
    """``cell``, ``block`` and the arrays ``words`` and ``counts`` of each block."""
    placed = words.withColumn("at", _cell(F.col("word"))).withColumn("cell", _key(F.col("at")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS).cast("int").alias("blocks"))
    return (placed.join(sizes, "cell")
            .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
            .groupBy("cell", "block").agg(F.first("at").alias("at"), F.collect_list(F.struct("word", "n")).alias("rows"))
            .select("cell", "block", "at", F.col("rows.word").alias("words"), F.col("rows.n").alias("counts")))


def meetings(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks that may hold words an edit apart, each once."""
    left = blocks.select(F.explode(F.transform(_met(F.col("at")), _key)).alias("meets"), F.col("cell").alias("own"),
                         F.col("block").alias("a_block"), F.col("words").alias("a_words"),
                         F.col("counts").alias("a_counts"))
    right = blocks.select(F.col("cell").alias("meets"), "block", F.col("words").alias("b_words"),
                          F.col("counts").alias("b_counts"))
    inner = F.col("own") == F.col("meets")
    return (left.join(right, "meets").where(~inner | (F.col("a_block") <= F.col("block")))
            .select("a_words", "a_counts", "b_words", "b_counts",
                    (inner & (F.col("a_block") == F.col("block"))).alias("same")))


# ---------------------------------------------------------------- products


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(owner * _LETTERS + letter, minlength=len(words) * _LETTERS)
    return flat.reshape(len(words), _LETTERS).astype(np.float64)


def one_edit(a: str, b: str) -> bool:
    """The words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def near_in_blocks(a: list[str], b: list[str], same: bool) -> list[tuple[int, int]]:
    """Places of the words of two blocks that are one edit apart; of one block, each pair once."""
    x = letter_counts(a)
    y = x if same else letter_counts(b)
    apart = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero((apart <= 2) & (apart > 0))
    return [(p, q) for p, q in zip(i.tolist(), j.tolist()) if (not same or p < q) and one_edit(a[p], b[q])]


def near_words(words: DataFrame) -> DataFrame:
    """Each near pair from both sides: ``word``, ``near`` and the count ``near_n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, a_n, b, b_n, same = (batch.column(c)[k].as_py() for c in range(5))
                found = near_in_blocks(a, b, same)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[p] for p, _ in found] + [b[q] for _, q in found], pa.string()),
                    pa.array([b[q] for _, q in found] + [a[p] for p, _ in found], pa.string()),
                    pa.array([b_n[q] for _, q in found] + [a_n[p] for p, _ in found], pa.int64()),
                ], names=["word", "near", "near_n"])

    blocks = keep(blocked(words))
    return meetings(blocks).mapInArrow(run, "word string, near string, near_n long")


# ---------------------------------------------------------------- forms


def follow(forms: DataFrame, steps: int) -> DataFrame:
    """``word`` and ``root``: where following ``form`` ends, for chains of at most ``steps``."""
    roots = keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = keep(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return roots


def variants(words: DataFrame) -> DataFrame:
    """Form, root and near words of each of ``words`` (``word``, ``n``; every word once)."""
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("n_near").isNotNull() & (-F.col("best.order") >= RATIO * F.col("n"))
    judged = keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.order")).alias("form_n")))
    most = judged.agg(F.max("n")).first()[0] or 1
    roots = follow(judged.where("form IS NOT NULL"), int(math.log(most, RATIO)) + 1)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """Every word of the documents with its form and root."""
    return variants(keep(vocabulary(docs)))
