"""Resolution of spoken text against reference tables.

Work runs on the distinct texts only, in stages: exact key, separator-free
code, similarity. The similarity stage is an equi-join on signatures that no
pair above the threshold can miss, so it never forms a cross product, however
large the vocabulary is. No broadcast is forced: Spark broadcasts a side when
its measured size allows and shuffles otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.similarity import jaro_winkler
from tallyline.functions.text import depluralize, fold, strip_separators, trim_space
from tallyline.session import cut_lineage

# Acceptance threshold and score of a code match.
THRESHOLD = 0.85
CODE_SCORE = 0.98
#: keys that texts without any word are dealt to
EMPTY_KEYS = 4096


def reference_keys(dim: DataFrame, id_col: str) -> DataFrame:
    """Comparison keys ``(id, fold, canon, deplu)`` of name, id and aliases."""
    raw = F.concat(F.array("name", F.col(id_col)),
                   F.coalesce("aliases", F.array().cast("array<string>")))
    keys = dim.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(
        F.transform(raw, lambda r: fold(trim_space(r))))).alias("fold")).where("fold != ''")
    return keys.withColumns({"canon": strip_separators("fold"), "deplu": depluralize("fold")})


# --- signatures ------------------------------------------------------------
#
# Score = j + 0.1 p (1 - j) with p <= 4 common leading characters, and
# j <= (m/la + m/lb + 1) / 3 with m at most the number c of common characters.
# A score of at least t therefore needs j >= (t - 0.1 p) / (1 - 0.1 p) and
# c (1/la + 1/lb) >= k = 3 j - 1; for t = 0.85, k is 1.25 in general and 1.4375
# for pairs with p <= 2. Two bags sharing c of their characters share e <= c of
# them within the first (length - c + e) in any fixed order (prefix filter). A
# signature is e such characters plus the length classes of both sides; pairs
# with p >= 3 also carry the three leading characters.

_COMMON = "etaoinsrlcdmuphgbfyvkwxzjq0123456789 -"
_RATIO = 1.25
_LONG = 40


def _need(threshold: float, prefix: int) -> float:
    return 3 * (threshold - 0.1 * prefix) / (1 - 0.1 * prefix) - 1


def _families(threshold: float) -> list[tuple[str, float, int]]:
    """Name, k and the largest distance of length classes per signature family."""
    out = []
    for name, prefix in (("p3", 4), ("p0", 2)):
        k = _need(threshold, prefix) - 1e-9
        out.append((name, k, math.floor(math.log(1 / (k - 1)) / math.log(_RATIO)) + 1))
    return out


def _bin(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(_RATIO)) + 1e-9).cast("int")


def _bin_min(b: Column) -> Column:
    return F.greatest(F.ceil(F.pow(F.lit(_RATIO), b) - 1e-9), F.lit(1)).cast("double")


def _bag(s: Column) -> Column:
    """Characters with their occurrence number, rare characters first."""
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    ranked = F.array_sort(F.transform(chars, lambda c: F.struct(
        F.when(F.call_function("instr", F.lit(_COMMON), c) == 0, 0)
        .otherwise(1000 - F.call_function("instr", F.lit(_COMMON), c)).alias("r"), c.alias("c"))))
    return F.transform(ranked, lambda x: x["c"])


def _numbered(bag: Column) -> Column:
    """Equal neighbours of a sorted bag become distinct: a, a -> a0, a1."""
    return F.transform(bag, lambda c, i: F.concat(
        c, (i + 1 - F.array_position(bag, c)).cast("string")))


def _signatures(strings: DataFrame, bins: DataFrame, mine: str, other: str,
                threshold: float) -> DataFrame:
    """Signatures of ``(s, form)`` rows against the length classes in ``bins``."""
    base = strings.withColumns({"n": F.length("s").cast("double"), "_bag": _bag(F.col("s"))})
    base = base.withColumns({"tokens": _numbered(F.col("_bag")), mine: _bin(F.col("n"))}).drop("_bag")
    out = None
    for family, k, reach in _families(threshold):
        part = base.withColumn(other, F.explode(F.sequence(
            F.greatest(F.col(mine) - reach, F.lit(0)), F.col(mine) + reach)))
        part = part.join(bins.withColumnRenamed("bin", other), other)
        mins = (_bin_min(F.col(mine)), _bin_min(F.col(other)))
        shared = F.ceil(k * mins[0] * mins[1] / (mins[0] + mins[1]) - 1e-9)
        two = (shared >= 2) & (F.greatest(*mins) <= _LONG)
        need = F.ceil(k * F.col("n") * mins[1] / (F.col("n") + mins[1]) - 1e-9)
        part = part.withColumns({"two": two, "keep": (
            F.col("n") - need + F.when(two, 2).otherwise(1)).cast("int")})
        part = part.where("keep > 0").withColumn("pre", F.slice("tokens", 1, F.col("keep")))
        pairs = F.flatten(F.transform("pre", lambda x, i: F.transform(
            F.slice(F.col("pre"), i + 2, F.size("pre")), lambda y: F.concat(x, y))))
        part = part.withColumn("sig", F.explode(F.when(F.col("two"), pairs).otherwise(F.col("pre"))))
        lead = F.left("s", F.lit(3)) if family == "p3" else F.lit("")
        part = part.select("s", "form", F.concat_ws(
            "\ufdd4", F.lit(family), "form", F.col("qbin").cast("string"),
            F.col("kbin").cast("string"), lead, "sig").alias("sig"))
        out = part if out is None else out.unionByName(part)
    return out


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``(q, k, form, score)`` of distinct strings at or above the threshold.

    Both sides are ``(s, form)``; only equal forms are compared. Exact for
    thresholds of 0.85 and above.
    """
    if threshold < THRESHOLD:
        raise ValueError("signatures are exact for thresholds of 0.85 and above")
    lbins = left.select(_bin(F.length("s")).alias("bin")).distinct()
    rbins = right.select(_bin(F.length("s")).alias("bin")).distinct()
    ls = _signatures(left, rbins, "qbin", "kbin", threshold).withColumnRenamed("s", "q")
    rs = _signatures(right, lbins, "kbin", "qbin", threshold).select(F.col("s").alias("k"), "sig")
    pairs = ls.join(rs, "sig").select("q", "k", "form").distinct()
    short = F.least(F.length("q"), F.length("k"))
    long = F.greatest(F.length("q"), F.length("k"))
    return (
        pairs.where(1 + short / long >= _need(threshold, 4) - 1e-9)
        .withColumn("score", jaro_winkler("q", "k"))
        .where(F.col("score") >= threshold - 1e-12)
    )


def _forms(df: DataFrame, fold_col: str, deplu_col: str) -> DataFrame:
    return df.select(F.explode(F.array(
        F.struct(F.col(fold_col).alias("s"), F.lit("f").alias("form")),
        F.struct(F.col(deplu_col).alias("s"), F.lit("d").alias("form")),
    )).alias("x")).select("x.*").where("s != ''").distinct()


def match_texts(texts: DataFrame, keys: DataFrame, code: bool,
                threshold: float = THRESHOLD) -> DataFrame:
    """Best reference id per distinct folded text: ``(fold, id, score)``.

    Ties go to the smallest id. Texts without a match above the threshold are
    absent.
    """
    # the distinct texts are read several times below: written once
    q = cut_lineage(texts.select(F.col("fold")).where("fold != ''").distinct())
    exact = q.join(keys.select("fold", "id"), "fold").groupBy("fold").agg(
        F.min("id").alias("id")).withColumn("score", F.lit(1.0))
    rest = cut_lineage(q.join(exact, "fold", "left_anti")).withColumns({
        "canon": strip_separators("fold"), "deplu": depluralize("fold")})
    if rest.isEmpty():
        return exact
    k = keys.select("id", F.col("fold").alias("kfold"), F.col("canon").alias("kcanon"),
                    F.col("deplu").alias("kdeplu"))

    def by_similarity(part: DataFrame, at_least: float) -> DataFrame:
        pairs = similar_pairs(_forms(part, "fold", "deplu"), _forms(keys, "fold", "deplu"), at_least)
        plain = pairs.where("form = 'f'").select(
            F.col("q").alias("fold"), F.col("k").alias("kfold"), "score")
        single = pairs.where("form = 'd'").select(
            F.col("q").alias("deplu"), F.col("k").alias("kdeplu"), "score")
        return (
            plain.join(part, "fold").join(k, "kfold")
            .select("fold", "canon", "id", "kcanon", "score")
            .unionByName(single.join(part, "deplu").join(k, "kdeplu")
                         .select("fold", "canon", "id", "kcanon", "score"))
        )

    if not code:
        scored = by_similarity(rest, threshold).select("fold", "id", "score")
    else:
        codes = cut_lineage(rest.where("canon != ''").join(
            k, F.col("canon") == F.col("kcanon")).groupBy("fold").agg(F.min("id").alias("id"))
        ).withColumn("score", F.lit(CODE_SCORE))
        # next to a code match only a higher similarity matters; a key equal as
        # a code scores as a code, never by similarity
        uncoded = rest.join(codes, "fold", "left_anti")
        coded = rest.join(codes, "fold", "left_semi")
        scored = codes
        for part, at_least in ((uncoded, threshold), (coded, CODE_SCORE)):
            if not part.isEmpty():
                scored = scored.unionByName(by_similarity(part, at_least).where(
                    (F.col("canon") == "") | (F.col("canon") != F.col("kcanon"))
                ).select("fold", "id", "score"))
    best = scored.groupBy("fold").agg(F.min(F.struct(
        (-F.col("score")).alias("s"), F.col("id").alias("id"))).alias("b"))
    return exact.unionByName(best.select(
        "fold", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score")))


def resolve(df: DataFrame, text: str, dim: DataFrame, id_col: str, out_id: str,
            out_score: str, code: bool, threshold: float = THRESHOLD) -> DataFrame:
    """Add the resolved id and score of a text column; null when unresolved."""
    keys = reference_keys(dim, id_col)
    df = df.withColumn("_folded", fold(trim_space(text)))
    hits = match_texts(df.select(F.col("_folded").alias("fold")), keys, code, threshold).select(
        F.col("fold").alias("_folded"), F.col("id").alias(out_id), F.col("score").alias(out_score))
    # empty texts match nothing: dealt over many keys, they do not meet in one task
    apart = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(EMPTY_KEYS)).cast("string"))
    df = df.withColumn("_folded", F.when(F.coalesce("_folded", F.lit("")) == "", apart).otherwise(F.col("_folded")))
    return df.join(hits, "_folded", "left").drop("_folded")


def has_rows(dim: DataFrame | None) -> bool:
    """Whether reference data is loaded at all (reads one row)."""
    return dim is not None and not dim.isEmpty()


def certainty(text: Column, found_id: Column, score: Column, loaded: bool,
              unmatched: float, unloaded: float) -> Column:
    """Slot certainty: the score, or less without a match or without reference data."""
    return (
        F.when(text == "", F.lit(0.0)).when(found_id.isNotNull(), score)
        .otherwise(F.lit(unmatched if loaded else unloaded))
    )


def resolve_parse(df: DataFrame, locations: DataFrame | None, parts: DataFrame | None,
                  parse: str = "parse") -> DataFrame:
    """Fill ids, scores and certainties of location and item into a parse."""
    p = F.col(parse)
    has_l, has_p = has_rows(locations), has_rows(parts)
    df = df.withColumns({"_lt": p["location_text"], "_pt": p["item_text"]})
    none = {"s": F.lit(None).cast("string"), "d": F.lit(None).cast("double")}
    if has_l:
        df = resolve(df, "_lt", locations, "id", "_lid", "_ls", code=True)
    else:
        df = df.withColumns({"_lid": none["s"], "_ls": none["d"]})
    if has_p:
        df = resolve(df, "_pt", parts, "part_number", "_pid", "_ps", code=False)
    else:
        df = df.withColumns({"_pid": none["s"], "_ps": none["d"]})
    return df.withColumn(parse, p.withField("location_id", F.col("_lid")).withField(
        "part_number", F.col("_pid")).withField("location_score", F.col("_ls")).withField(
        "item_score", F.col("_ps")).withField("cert_location", certainty(
            p["location_text"], F.col("_lid"), F.col("_ls"), has_l, 0.6, 0.75)).withField(
        "cert_item", certainty(p["item_text"], F.col("_pid"), F.col("_ps"), has_p, 0.7, 0.8))
    ).drop("_lt", "_pt", "_lid", "_ls", "_pid", "_ps")
