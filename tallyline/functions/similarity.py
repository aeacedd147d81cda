"""String similarity as Catalyst expressions, over code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import col

_USED = "\ufdd3"  # noncharacter: a matched position


def levenshtein(a, b) -> Column:
    return F.levenshtein(col(a), col(b))


def similarity(a, b) -> Column:
    """1 - edit distance / longer length; two empty strings are identical."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def jaro(a, b) -> Column:
    """Jaro similarity; transpositions count halves, unrounded."""
    a, b = col(a), col(b)
    la, lb = F.length(a), F.length(b)
    window = F.greatest((F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))

    def take(s: Column, ch: Column, i: Column) -> Column:
        # first unused equal character inside the window, by text search
        low = F.greatest(i - window, F.lit(0))
        part = F.substr(s["rest"], low + 1, F.greatest(i + window + 1 - low, F.lit(0)))
        bound = F.transform(F.array(F.struct(
            F.call_function("instr", part, ch).alias("at"), low.alias("low"))),
            lambda p: F.when(p["at"] > 0, F.struct(
                (s["i"] + 1).alias("i"),
                F.overlay(s["rest"], F.lit(_USED), p["low"] + p["at"], F.lit(1)).alias("rest"),
                F.concat(s["hit"], ch).alias("hit"),
            )).otherwise(F.struct(
                (s["i"] + 1).alias("i"), s["rest"].alias("rest"), s["hit"].alias("hit"))))
        return F.get(bound, F.lit(0))

    start = F.struct(F.lit(0).alias("i"), b.alias("rest"), F.lit("").alias("hit"))

    def score(s: Column) -> Column:
        hit_a = _chars(s["hit"])
        hit_b = F.filter(F.zip_with(
            _chars(b), _chars(s["rest"]), lambda c, r: F.when(r == _USED, c)),
            lambda c: c.isNotNull())
        moved = F.size(F.filter(F.zip_with(hit_a, hit_b, lambda x, y: x != y), lambda d: d))
        m = F.length(s["hit"]).cast("double")
        return F.when(m == 0, F.lit(0.0)).otherwise(
            (m / la + m / lb + (m - moved / 2) / m) / 3)

    folded = F.aggregate(_chars(a), start, lambda s, ch: take(s, ch, s["i"]), score)
    return (
        F.when((la == 0) & (lb == 0), F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0))
        .otherwise(folded)
    )


def common_prefix(a, b, longest: int = 4) -> Column:
    a, b = col(a), col(b)
    n = F.lit(0)
    for k in range(1, longest + 1):
        n = n + F.when((F.length(a) >= k) & (F.length(b) >= k)
                       & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))), 1).otherwise(0)
    return n


def jaro_winkler(a, b) -> Column:
    """Jaro plus 0.1 per common leading character, at most four, always applied."""
    bound = F.transform(F.array(jaro(a, b)), lambda j: j + common_prefix(a, b) * 0.1 * (1 - j))
    return F.get(bound, F.lit(0))
