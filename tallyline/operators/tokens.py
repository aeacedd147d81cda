"""Tokens of an utterance, kept as aligned arrays inside the row.

Tokenising, number scanning and slot filling all stay narrow: one utterance is
one row from scan to result, so extraction needs no shuffle at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import fold

# Punctuation stripped at the start and the end of a word, and
# the marks that close a clause.
LEAD = "(\\[{\"'¿¡«“‘"
TRAIL = ")\\]}\"'»”’"
CLAUSE = ",;.!?:…"

# marks a clause end inside the normalised text; a noncharacter, never in text
END = "\ufdd0"


def with_norm(df: DataFrame, text: Column, out: str = "_norm") -> DataFrame:
    """Add the text as words separated by single spaces; clause-ending words carry END.

    Every rewrite is its own projection behind a cheap test, so plain utterances
    skip most of them.
    """
    anyp = TRAIL + CLAUSE
    n = F.col(out)

    def when(test: Column, rewritten: Column) -> Column:
        return F.when(test, rewritten).otherwise(n)

    df = df.withColumn(out, F.regexp_replace(
        F.coalesce(text, F.lit("")), f"(?U)[\\s{END}]+", " "))
    # a lone ASCII dash vanishes, a lone typographic dash closes the clause
    df = df.withColumn(out, when(
        n.contains("-"), F.regexp_replace(n, "(?<![^ ])-(?![^ ])", "")))
    df = df.withColumn(out, when(
        n.contains("—") | n.contains("–"), F.regexp_replace(n, "(?<![^ ])[—–](?![^ ])", ",")))
    df = df.withColumn(out, when(
        n.rlike(f"[{LEAD}]"), F.regexp_replace(n, f"(?<![^ ])[{LEAD}]++", "")))
    # punctuation at a word's end shrinks to its clause mark, if it has one
    df = df.withColumn(out, when(n.rlike(f"[{anyp}]"), F.regexp_replace(
        n,
        f"(?=[{anyp}])(?<![{anyp}])(?:[{TRAIL}]*+([{CLAUSE}])[{anyp}]*+|[{TRAIL}]++)(?![^ ])",
        "$1",
    )))
    # words of letter groups joined by hyphens fall apart; codes stay whole
    df = df.withColumn(out, when(n.contains("-"), F.regexp_replace(
        n,
        f"(?:(?<![^ ])(?=\\p{{L}}++(?:-\\p{{L}}++)++[{CLAUSE}]?+(?![^ ]))|\\G(?!^)-)(\\p{{L}}++)",
        " $1",
    )))
    # an end mark belongs to the word before it; the text end is a clause end
    df = df.withColumn(out, F.trim(F.regexp_replace(
        F.concat(n, F.lit(" ,")), f"(?: *[{CLAUSE}](?![^ ]))++ *", END + " ")))
    df = df.withColumn(out, when(n.contains("  "), F.regexp_replace(n, " ++", " ")))
    return df.withColumn(out, when(
        n.startswith(END), F.regexp_replace(n, f"^{END} ?", "")))


def fence(df: DataFrame, *names: str) -> DataFrame:
    """Keep later filters on ``names`` above this point.

    A filter on an extracted column would otherwise be rewritten in terms of
    the text, repeating the whole chain of projections inside the condition.
    Filters on other columns still reach the scan.
    """
    rest = [c for c in df.columns if c not in names]
    boxed = df.select(*rest, F.explode_outer(F.array(F.struct(*names))).alias("_box"))
    return boxed.select(*rest, *[F.col(f"_box.{n}").alias(n) for n in names])


def words_of(norm: Column) -> Column:
    """Original spelling of the tokens."""
    plain = F.replace(norm, F.lit(END), F.lit(""))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def flags_of(norm: Column) -> Column:
    """``;`` for tokens that end a clause, else ``,``."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(norm, " "), lambda w: F.when(w.endswith(END), ";").otherwise(","))
    )


def with_tokens(df: DataFrame, norm: str = "_norm") -> DataFrame:
    """Add ``_orig``, ``_fold`` and ``_flag``, three aligned arrays."""
    n = F.col(norm)
    return df.withColumns({
        "_orig": words_of(n), "_fold": words_of(fold(n)), "_flag": flags_of(n),
    })


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``out``: array of ``{pos, orig, fold, clause_end, clause}``."""
    df = with_tokens(with_norm(df, F.col(text)))
    clause_end = F.transform("_flag", lambda f: f == ";")
    df = df.withColumn("_end", clause_end)
    # running count of clause ends before the token, as one pass that emits the
    # clause index of every token: clause sizes, then repeat
    sizes = F.transform(
        F.filter(F.split(F.array_join("_flag", ""), ";"), lambda s: s.isNotNull()),
        lambda s: F.length(s) + 1,
    )
    df = df.withColumn(
        "_clause", F.flatten(F.transform(sizes, lambda n, c: F.array_repeat(c, n)))
    )
    zipped = F.arrays_zip("_orig", "_fold", "_end", "_clause")
    # arrays_zip keeps the arrays outside the lambda (see numbers.with_cells)
    df = df.withColumn(out, F.transform(
        F.slice(zipped, 1, F.size("_orig")),
        lambda z, i: F.struct(
            i.alias("pos"), z["_orig"].alias("orig"), z["_fold"].alias("fold"),
            z["_end"].alias("clause_end"), z["_clause"].alias("clause"),
        )),
    ).drop("_norm", "_orig", "_fold", "_flag", "_end", "_clause")
    return fence(df, out)
