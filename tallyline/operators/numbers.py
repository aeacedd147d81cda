"""Spoken numbers over the token arrays.

Three steps, all inside the row:

1. every token gets a one-letter number class (a lookup in the vocabulary),
2. the classes form a string, on which regular expressions resolve everything
   that depends on the following words (articles before scales, halves,
   connectors, vague phrases),
3. one ``aggregate`` over the resolved classes builds the number spans.

Number classes after step 2::

    o u  small value (u: a Spanish article)      t  tens        h  direct hundreds
    A    article standing for one                C  hundred     B  thousand, million
    D    dozen (ends a run)                      H  half        &  connector   d  digits
    S N E  vague phrase: seeds the scale after it / swallows it / stands alone
    s n e  the same, but readable as "one" inside a running number
    w    second word of a vague phrase           .  anything else
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import is_code, is_number, parse_digits
from tallyline.lexicon import Language, by_language, map_literal

SPAN = "struct<value:double,approx:boolean,vague:boolean,start:int,end:int>"


def _number_class(t: Language, w: str) -> tuple[str, float | None]:
    """Class and value of a word on its own."""
    if w in t.number_articles:
        return ("u", 1.0) if w in t.ones else ("a", None)
    for name, letter in (("ones", "o"), ("tens", "t"), ("hundreds", "h"), ("big", "B")):
        if w in getattr(t, name):
            return letter, getattr(t, name)[w]
    for name, letter in (("hundred", "C"), ("dozen", "D"), ("half", "H"), ("connectors", "&")):
        if w in getattr(t, name):
            return letter, None
    if w in t.vague:
        return ("Q", None) if t.vague[w] is None else ("K", t.vague[w])
    return ".", None


def _entry(t: Language, w: str) -> str:
    """Code of a vocabulary word: negation, unit, kind, location, number,
    approximation, and whether it begins a longer phrase."""
    loc = "'" if len(w) == 1 else "-"
    if w in t.preps:
        loc = "@"
    elif w in t.nouns:
        loc = "#" if w in t.kept_nouns else "&"
    elif w in t.articles:
        loc = "%"
    kind = "-"
    for name, letter in (("of", "o"), ("number_articles", "a"), ("conjunctions", "c")):
        if w in getattr(t, name):
            kind = letter
    longer = any(p.startswith(w + " ") for p in (*t.negation, *t.vague, *t.approx))
    return "".join((
        "$" if w in t.negation else "-", "u" if w in t.units else "-", kind, loc,
        _number_class(t, w)[0], "1" if w in t.approx else "0", "+" if longer else "-",
    ))


def _codes(t: Language) -> Column:
    """26 small maps by first letter, so a lookup scans a handful of keys."""
    by_letter: dict[str, dict[str, str]] = {chr(97 + k): {"-": ""} for k in range(26)}
    for w in t.vocabulary:
        by_letter[w[0]][w] = _entry(t, w)
    return F.expr("array(" + ", ".join(map_literal(m) for m in by_letter.values()) + ")")


def _phrases(entries, n: int) -> list[str]:
    return [p for p in entries if len(p.split()) == n]


def _known_lengths(t: Language) -> None:
    """The class codes hold phrases up to these lengths; a longer one must not be lost."""
    for name, entries, longest in (("negation", t.negation, 2), ("vague", t.vague, 2), ("approx", t.approx, 3)):
        long = [p for p in entries if len(p.split()) > longest]
        if long:
            raise ValueError(f"{t.code}: {name} phrases of more than {longest} words: {long}")


def with_classes(df: DataFrame, lang: str = "lang", extra_units: list[str] | None = None,
                 unit_words: str | None = None) -> DataFrame:
    """Add ``_code``, the seven-character class code of every token, and ``_raw``.

    ``extra_units`` is a short list of further unit words; ``unit_words`` names
    an array column with the further unit words found in the row.
    """
    lg = F.col(lang)

    def code(t: Language):
        def of(f: Column) -> Column:
            return F.coalesce(
                F.try_element_at(F.get(_codes(t), F.ascii(f) - 97), f),
                F.when((F.length(f) == 1) & f.between("a", "z"), "---'.0-")
                .when(f.rlike("[0-9]"), F.when(is_code(f), "---!.0-").when(
                    is_number(f), "----d0-")),
                F.lit("----.0-"),
            )
        return of

    df = df.withColumn("_code", by_language(lg, lambda t: F.transform("_fold", code(t))))
    if extra_units or unit_words:
        def extra(k: Column, i: Column) -> Column:
            f = F.get("_fold", i)
            hit = f.isin(*extra_units) if extra_units else F.lit(False)
            if unit_words:
                hit = hit | F.coalesce(F.array_contains(F.col(unit_words), f), F.lit(False))
            return F.when(hit, F.concat(F.left(k, F.lit(1)), F.lit("u"), F.substring(k, 3, 5))).otherwise(k)
        df = df.withColumn("_code", F.transform("_code", extra))

    def phrase(t: Language):
        _known_lengths(t)
        two_neg = _phrases(t.negation, 2)
        approx3, approx2 = _phrases(t.approx, 3), _phrases(t.approx, 2)

        def of(k: Column, i: Column) -> Column:
            f = F.get("_fold", i)
            pair = F.concat_ws(" ", f, F.get("_fold", i + 1))
            triple = F.concat_ws(" ", pair, F.get("_fold", i + 2))
            number = F.substring(k, 5, 1)
            for p in _phrases(t.vague, 2):
                letter = "R" if t.vague[p] is None else "J"
                if p.split()[0] in t.ones:
                    letter = letter.lower()
                number = F.when(pair == p, letter).otherwise(number)
            return F.when(F.endswith(k, F.lit("+")), F.concat(
                F.when(pair.isin(*two_neg), "<").otherwise(F.left(k, F.lit(1))),
                F.substring(k, 2, 3), number,
                F.when(triple.isin(*approx3), "3").when(pair.isin(*approx2), "2")
                .otherwise(F.substring(k, 6, 1)),
                F.lit("-"),
            )).otherwise(k)
        return of

    df = df.withColumn("_code", F.when(
        F.array_join("_code", "").contains("+"),
        by_language(lg, lambda t: F.transform("_code", phrase(t)))).otherwise(F.col("_code")))
    return df.withColumn("_raw", F.regexp_replace(F.array_join("_code", ""), "....(.)..", "$1"))


# classes that can begin a number, and those that scale one
_BEGIN = "[othCBDdujr]"
_SCALE = "[CBD]"
_RUN = "[outhACBDHdSNEsnejr]"


def _resolve_vague(c: Column) -> Column:
    """Vague phrases seed a scale, swallow a scale, give way, or stand alone."""
    r = F.regexp_replace
    c = r(c, f"J.(?={_SCALE})", "Sw")
    c = r(c, f"R.(?={_SCALE})", "Nw")
    c = r(c, f"j.(?={_SCALE})", "sw")
    c = r(c, f"r.(?={_SCALE})", "nw")
    c = r(c, f"[JR](?=.{_BEGIN})", ".")
    c = r(c, f"[jr](?=.{_BEGIN})", "u")
    c = r(c, "[JR].", "Ew")
    c = r(c, "[jr].", "ew")
    c = r(c, f"K(?={_SCALE})", "S")
    c = r(c, f"Q(?={_SCALE})", "N")
    c = r(c, "[KQ](?=[othCBDduesn])", ".")
    return r(c, "[KQ]", "E")


def _resolve_function_words(c: Column) -> Column:
    """Halves need a dozen ahead, articles a scale, connectors a number word."""
    r = F.regexp_replace
    c = r(c, "H(?![au]?D)", ".")
    c = r(c, f"a(?={_SCALE})", "A")
    c = r(c, "a", ".")
    return r(c, "&(?![othuesn])", ".")


def _span(value, approx, vague, start, end) -> Column:
    return F.struct(
        value.cast("double").alias("value"), approx.alias("approx"), vague.alias("vague"),
        start.cast("int").alias("start"), end.cast("int").alias("end"),
    )


def _fold_runs(steps: Column) -> Column:
    """Fold the class steps ``{c, v, i}`` into number spans."""
    no, yes = F.lit(False), F.lit(True)
    none = F.array().cast(f"array<{SPAN}>")

    def state(spans, run, started, start, total, cur, ones, tens, hund, half, vague, approx, skip):
        return F.struct(
            spans.alias("spans"), run.alias("run"), started.alias("started"),
            start.cast("int").alias("start"), total.cast("double").alias("total"),
            cur.cast("double").alias("cur"), ones.alias("ones"), tens.alias("tens"),
            hund.alias("hund"), half.alias("half"), vague.alias("vague"),
            approx.alias("approx"), skip.alias("skip"),
        )

    zero = F.lit(0.0)
    initial = state(none, no, no, F.lit(0), zero, zero, no, no, no, no, no, no, no)

    def idle(spans, skip=no):
        return state(spans, no, no, F.lit(0), zero, zero, no, no, no, no, no, no, skip)

    def step(s: Column, x: Column) -> Column:
        c, v, i = x["c"], x["v"], x["i"]
        cur = s["cur"]
        one = F.when(cur == 0, F.lit(1.0)).otherwise(cur)
        small = c.isin("o", "u", "s", "n", "e")
        goes_on = (
            F.when(small, ~s["ones"])
            .when(c == "A", ~s["ones"] & ~s["tens"] & (cur == 0))
            .when(c == "t", ~s["ones"] & ~s["tens"])
            .when(c == "h", ~s["ones"] & ~s["tens"] & ~s["hund"])
            .when(c == "C", ~s["hund"])
            .when(c == "B", (cur != 0) | ~s["started"])
            .otherwise(c == "&")
        )

        def value(total):
            return F.when(~s["vague"], total)

        # a dozen word closes the run it ends, or stands alone
        dozen = F.when(s["half"], one * 6).otherwise(one * 12)
        at_dozen = idle(F.concat(s["spans"], F.array(F.when(
            s["run"],
            _span(value(s["total"] + dozen), s["approx"], s["vague"], s["start"], i + 1),
        ).otherwise(_span(F.lit(12.0), no, no, i, i + 1)))))

        longer = state(
            s["spans"], yes, s["started"] | (c != "&"), s["start"],
            F.when(c == "B", s["total"] + one * v).otherwise(s["total"]),
            F.when(c.isin("s", "n", "e"), cur + 1).when(c.isin("o", "u", "t", "h"), cur + v)
            .when(c == "A", F.lit(1.0)).when(c == "C", one * 100)
            .when(c == "B", zero).otherwise(cur),
            F.when(c.isin("B", "C"), no).otherwise(s["ones"] | small | (c == "A")),
            F.when(c.isin("B", "C"), no).otherwise(s["tens"] | (c == "t")),
            F.when(c == "B", no).otherwise(s["hund"] | c.isin("h", "C")),
            s["half"], s["vague"], s["approx"], no,
        )

        closed = F.when(
            s["run"] & s["started"],
            F.array(_span(value(s["total"] + cur), s["approx"], s["vague"], s["start"], i)),
        ).otherwise(none)
        two = x["two"]
        alone = F.when(
            c.isin("E", "e"),
            F.array(_span(v, yes, v.isNull(), i, F.when(two, i + 2).otherwise(i + 1))),
        ).otherwise(none)
        begins = c.isin("o", "u", "t", "h", "A", "C", "B", "H", "d", "S", "s", "N", "n")
        seeded = c.isin("S", "s")
        swallowed = c.isin("N", "n")
        fresh = state(
            F.concat(s["spans"], closed, alone), begins, begins & ~swallowed & (c != "H"), i,
            F.when(c == "B", v).otherwise(zero),
            F.when(c.isin("o", "u", "t", "h", "d") | seeded, v).when(c == "A", F.lit(1.0))
            .when(c == "C", F.lit(100.0)).otherwise(zero),
            c.isin("o", "u", "A", "d") | seeded, c.isin("t", "d"), c.isin("h", "C"),
            c == "H", swallowed, seeded | swallowed,
            c.isin("S", "s", "N", "n", "E", "e") & two,
        )
        skipped = F.struct(*[
            (no if f == "skip" else s[f]).alias(f) for f in (
                "spans", "run", "started", "start", "total", "cur", "ones", "tens", "hund",
                "half", "vague", "approx", "skip")
        ])
        return (
            F.when(s["skip"] & (c == "w"), skipped)
            .when(~s["run"] & c.isin(".", "w", "&"), s)
            .when(c == "D", at_dozen)
            .when(s["run"] & goes_on, longer)
            .otherwise(fresh)
        )

    return F.aggregate(steps, initial, step, lambda s: s["spans"])


def _word_value(t: Language, c: Column, w: Column, pair: Column) -> Column:
    """Value of a number word or vague phrase; null for vague ones without value."""
    numbers = {**t.ones, **t.tens, **t.hundreds, **t.big}
    vague = {p: v for p, v in t.vague.items() if v is not None}
    return (
        F.when(c == "u", F.lit(1.0)).when(c == "d", parse_digits(w))
        .when(c.isin("S", "E", "s", "e"), F.coalesce(
            F.try_element_at(F.expr(map_literal(vague)), pair),
            F.try_element_at(F.expr(map_literal(vague)), w)))
        .when(c.isin("o", "t", "h", "B"), F.try_element_at(F.expr(map_literal(numbers)), w))
    )


def with_numbers(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Add ``_nums``: spans ``{value, approx, vague, mark_start, start, end}``."""
    cls = F.col("_raw")
    df = df.withColumn("_raw", F.when(cls.rlike("[JRjrKQ]"), _resolve_vague(cls)).otherwise(cls))
    df = df.withColumn("_raw", F.when(
        cls.rlike("[Ha&]"), _resolve_function_words(cls)).otherwise(cls))
    df = df.withColumn("_chars", F.when(cls.rlike(_RUN), F.regexp_extract_all(cls, F.lit("."), F.lit(0))))

    def steps(t: Language) -> Column:
        def of(c: Column, i: Column) -> Column:
            w, two = F.get("_fold", i), F.get("_chars", i + 1) == "w"
            pair = F.when(two, F.concat_ws(" ", w, F.get("_fold", i + 1)))
            return F.struct(c.alias("c"), i.alias("i"), _word_value(t, c, w, pair).alias("v"),
                            F.coalesce(two, F.lit(False)).alias("two"))
        return F.transform("_chars", of)

    # tokens far from any number cannot change the scan: one breaks a run, the
    # rest of a gap is left out
    df = df.withColumn("_steps", F.concat(
        F.filter(by_language(F.col(lang), steps), lambda x: (x["c"] != ".") | (
            F.get("_chars", x["i"] - 1) != ".")),
        F.array(F.struct(F.lit(".").alias("c"), F.length(cls).alias("i"),
                         F.lit(None).cast("double").alias("v"), F.lit(False).alias("two"))),
    ))
    df = df.withColumn("_spans", F.when(
        F.col("_chars").isNotNull(), _fold_runs(F.col("_steps"))
    ).otherwise(F.array().cast(f"array<{SPAN}>")))

    def marked(s: Column) -> Column:
        def reach(n):
            return F.substring(F.get("_code", s["start"] - n), 6, 1) == str(n)

        mark = s["start"] - (
            F.when(reach(3), 3).when(reach(2), 2).when(reach(1), 1).otherwise(0))
        return F.struct(
            s["value"].alias("value"), (s["approx"] | (mark < s["start"])).alias("approx"),
            s["vague"].alias("vague"), mark.alias("mark_start"), s["start"].alias("start"),
            s["end"].alias("end"),
        )

    return df.withColumn("_nums", F.transform("_spans", marked)).drop(
        "_spans", "_steps", "_chars", "_raw")


def is_location_number(n: Column) -> Column:
    """A whole, definite number a shelf or aisle can carry."""
    return ~n["vague"] & (n["value"] == F.floor(n["value"])) & n["value"].between(0, 9999)


def with_cells(df: DataFrame) -> DataFrame:
    """Add ``_S``, the utterance as a string of six-character cells.

    Cell: negation, unit, kind, location class, number role, clause flag. Number
    roles: ``=`` whole location-sized start, ``:`` other start, ``?`` vague
    start, ``_`` continuation, ``^`` approximation mark. Slot grammars are
    regular expressions over this string; a match position divided by six is a
    token position.
    """
    # number roles of all tokens: gap, marks, start, continuations per span
    df = df.withColumn("_gaps", F.transform("_nums", lambda n, k: F.coalesce(
        F.get("_nums", k - 1)["end"], F.lit(0))))

    def roles(n: Column, k: Column) -> Column:
        mark = F.greatest(n["mark_start"], F.get("_gaps", k))
        start = F.when(n["vague"], "?").when(is_location_number(n), "=").otherwise(":")
        return F.concat(
            F.repeat(F.lit("-"), mark - F.get("_gaps", k)),
            F.repeat(F.lit("^"), n["start"] - mark),
            start,
            F.repeat(F.lit("_"), n["end"] - n["start"] - 1),
        )

    df = df.withColumn("_roles", F.regexp_extract_all(F.concat(
        F.array_join(F.transform("_nums", roles), ""),
        F.repeat(F.lit("-"), F.size("_fold") - F.coalesce(
            F.get("_nums", F.size("_nums") - 1)["end"], F.lit(0))),
    ), F.lit("."), F.lit(0)))
    # zip_with keeps the arrays outside the lambda: a column that only a lambda
    # reads would be folded into it and computed anew for every token
    role_flag = F.zip_with("_roles", "_flag", lambda r, f: F.concat(r, f))
    cells = F.zip_with("_code", role_flag, lambda k, rf: F.concat(F.left(k, F.lit(4)), rf))
    return df.withColumn("_cells", cells).withColumn(
        "_S", F.array_join("_cells", "")).drop("_gaps", "_roles", "_code", "_flag")
