"""Utterance text to inventory slots.

Slots are found by regular expressions over the cell string of an utterance
(see ``numbers.with_cells``), in a fixed order, each claiming its tokens by
overwriting their cells: location, inline corrections, quantity and unit,
article quantity, item, description. Everything is a projection: no shuffle,
no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import all_in, code_display, format_quantity, trim_space
from tallyline.lexicon import by_language, in_set, map_literal
from tallyline.operators.numbers import with_cells, with_classes, with_numbers
from tallyline.operators.tokens import END, fence, with_norm, with_tokens
from tallyline.session import dealt

# --- cell patterns ---------------------------------------------------------

_ANY = "[^,;]"
_FREE = "[^x,;]"  # first character of a cell no slot has claimed


def _cell(neg=_FREE, unit=_ANY, kind=_ANY, loc=_ANY, num=_ANY) -> str:
    return neg + unit + kind + loc + num


_START = "(?<![^,;])"  # a cell boundary
_TOKEN = _cell()
_PREP, _ART, _NOUN = _cell(loc="@"), _cell(loc="%"), _cell(loc="[&#]")
_CODE, _LETTER = _cell(loc="!"), _cell(loc="'")
_CONT = _cell(num="_")
# a whole number with all its words in one clause
_INT = f"{_cell(num='=')}(?:,{_CONT})*+(?![,;]{_CONT})"
_VALUE = f"(?>{_CODE}|{_LETTER},{_INT}|{_LETTER}|{_INT})"
_SEGMENT = f"(?>{_PREP},(?:{_ART},)*+(?:{_NOUN},{_VALUE}|{_CODE})|{_NOUN},{_VALUE})"
LOCATION = f"{_START}{_SEGMENT}(?:,{_SEGMENT})*+[,;]"

# a definite number with its marks, and optionally a known unit
_DEFINITE = (
    f"(?:{_cell(num=r'\^')}[,;])*+{_cell(num='[=:]')}(?:[,;]{_CONT})*+(?![,;]{_CONT})"
)
_QUANTITY_VALUE = f"{_DEFINITE}(?:[,;]{_cell(unit='u')})?"
# a value that covers the rest of a clause
_LOCATION_VALUE = f"(?:{_CODE}|{_LETTER},{_INT}|{_SEGMENT}(?:,{_SEGMENT})*+)"
_NEGATION = f"(?:{_cell(neg=r'\$')}|{_cell(neg='<')}[,;]{_ANY * 5})"
_AFTER = "(?<=[,;])"  # not at the first token
FIX_LOCATION = f"{_LOCATION_VALUE};"
FIX_QUANTITY = (
    f"(?:{_cell(num=r'\^')},)*+{_cell(num='[=:]')}(?:,{_CONT})*+"
    f"(?:,{_cell(unit='u')})?;(?!{_CONT})"
)
FIX_ANY = f"{_AFTER}{_NEGATION}[,;](?:{FIX_LOCATION}|{FIX_QUANTITY})"

_OF = _cell(neg=_ANY, kind="o")
_MARKS = f"((?:{_cell(num=r'\^')}[,;])*+)"
_NUMBER = f"({_cell(num='[=:?]')}(?:[,;]{_CONT})*+)"
QUANTITY = (
    f"{_START}{_MARKS}{_NUMBER}((?:,{_OF})*+)"
    f"(?:,({_cell(unit='u')}|{_TOKEN}(?=,{_OF})))?(?:,{_OF})*+[,;]"
)
ARTICLE = f"{_START}{_cell(kind='a')},{_cell(unit='u')}(?:,{_OF})*+[,;]"
ITEM = f"{_START}{_TOKEN}(?:,{_TOKEN})*+[,;]"

# whole utterances as standalone values
WHOLE_LOCATION = (
    f"^(?:{_CODE}|{_LETTER}[,;]{_cell(num='=')}(?:[,;]{_CONT})*+"
    f"|{_SEGMENT}(?:[,;]{_SEGMENT})*+);$"
)
WHOLE_QUANTITY = f"^{_QUANTITY_VALUE};$"

_WIDTH = 6


def _tokens_in(s: Column) -> Column:
    return (F.length(s) / _WIDTH).cast("int")


_CLASSES = "-$<uoac@%&#!'=:?_^"


def _claim(s: Column) -> Column:
    """Cells no later stage matches: every class character becomes ``x``."""
    return F.translate(s, _CLASSES, "x" * len(_CLASSES))


def _has(cells: str, chars: str) -> Column:
    test = F.lit(False)
    for c in chars:
        test = test | F.col(cells).contains(c)
    return test


def _find(df: DataFrame, cells: str, pattern: str, out: str, guard: Column,
          groups: int = 0) -> DataFrame:
    """Split ``cells`` around the first match of ``pattern`` into array ``out``.

    ``[before, match, groups..., after]``; a single element when nothing matches.
    One rewrite puts the bars in, so position and length need no second search.
    """
    layout = "|".join(f"${k}" for k in range(1, groups + 4))
    marked = F.regexp_replace(cells, f"^(.*?)({pattern})(.*)$", layout)
    return df.withColumn(out, F.split(F.when(guard, marked).otherwise(F.col(cells)), "\\|"))


def _found(parts: str) -> Column:
    return F.size(parts) > 1


def _at(parts: str) -> Column:
    return F.when(_found(parts), _tokens_in(F.get(parts, F.lit(0))))


def _count(parts: str) -> Column:
    return _tokens_in(F.get(parts, F.lit(1)))


def _claimed(cells: str, parts: str) -> Column:
    """Cells with the match claimed."""
    return F.when(_found(parts), F.concat(
        F.get(parts, F.lit(0)), _claim(F.get(parts, F.lit(1))),
        F.element_at(parts, -1))).otherwise(F.col(cells))


def _render(cells: Column, start: Column, count: Column) -> Column:
    """Location text of the tokens ``[start, start + count)``."""

    def number_at(i: Column) -> Column:
        hit = F.filter("_nums", lambda n: n["start"] == i)
        return format_quantity(F.get(hit, F.lit(0))["value"])

    def piece(c: Column, k: Column) -> Column:
        i = start + k
        loc, num = F.substring(c, 4, 1), F.substring(c, 5, 1)
        before = F.substring(F.get(cells, i - 1), 4, 1)
        follow = F.when(k + 1 < count, F.substring(F.get(cells, i + 1), 5, 1))
        word = F.get("_fold", i)
        return (
            F.when(num == "_", "").when(loc == "#", F.concat(F.lit("|"), word, F.lit(" ")))
            .when(loc == "&", "|")
            .when(loc == "!", F.concat(
                F.when((k > 0) & before.isin("@", "%"), "|").otherwise(""), code_display(word)))
            .when(loc == "'", F.concat(F.upper(word), F.when(follow == "=", "-").otherwise("")))
            .when(num == "=", number_at(i)).otherwise("")
        )

    joined = F.array_join(F.transform(F.slice(cells, start + 1, count), piece), "")
    return F.replace(F.regexp_replace(joined, "^[|]", ""), F.lit("|"), F.lit(" / "))


def prepare(df: DataFrame, text: str | None = "text", lang: str = "lang",
            extra_units: list[str] | None = None, unit_words: str | None = None) -> DataFrame:
    """Tokenise and scan; adds the internal columns the slot stages read."""
    if text is not None:
        df = with_norm(df, F.col(text))
    df = with_classes(with_tokens(df).drop("_norm"), lang, extra_units, unit_words)
    return with_cells(with_numbers(df, lang))


INTERNAL = ["_norm", "_orig", "_fold", "_flag", "_code", "_nums", "_cells", "_S"]


def scan_numbers(df: DataFrame, text: str = "text", lang: str = "lang",
                 out: str = "numbers") -> DataFrame:
    """Add the number spans of a text, left to right and non-overlapping."""
    df = with_numbers(with_classes(with_tokens(with_norm(df, F.col(text))), lang), lang)
    return fence(df.withColumn(out, F.col("_nums")).drop(*INTERNAL), out)


def extract_location(df: DataFrame) -> DataFrame:
    """First group of adjacent location segments; claims its tokens."""
    df = _find(df, "_S", LOCATION, "_loc", _has("_S", "@&#"))
    return df.withColumns({
        "_loc_text": F.when(
            _found("_loc"), _render(F.col("_cells"), _at("_loc"), _count("_loc"))).otherwise(""),
        "_S1": _claimed("_S", "_loc"),
    })


def _last_fix(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """Position and length of the value of the last correction of one kind."""
    # everything up to the last match, the negation, its value
    marked = F.regexp_replace(
        "_S1", f"^(.*){_AFTER}({_NEGATION}[,;])({pattern})(.*)$", "$1|$2|$3|$4")
    df = df.withColumn(out, F.split(
        F.when(_has("_S1", "$<"), marked).otherwise(""), "\\|"))
    head = F.concat(F.get(out, F.lit(0)), F.get(out, F.lit(1)))
    return df.withColumns({
        f"{out}_at": F.when(_found(out), _tokens_in(head)),
        f"{out}_n": F.when(_found(out), _tokens_in(F.get(out, F.lit(2)))),
    })


def extract_corrections(df: DataFrame) -> DataFrame:
    """Corrections inside the utterance; the last value of a slot wins."""
    df = _last_fix(df, FIX_LOCATION, "_fl")
    df = _last_fix(df, FIX_QUANTITY, "_fq")
    number = F.get(F.filter("_nums", lambda n: (n["mark_start"] == F.col("_fq_at"))
                            | (n["start"] == F.col("_fq_at"))), F.lit(0))
    df = df.withColumns({
        "_fix_loc": F.when(
            _found("_fl"), _render(F.col("_cells"), F.col("_fl_at"), F.col("_fl_n"))),
        "_fix_num": F.when(_found("_fq"), number),
    })
    last = F.col("_fq_at") + F.col("_fq_n") - 1
    # claim every correction: bars around the matches, every second part is one
    parts = F.split(F.regexp_replace("_S1", f"{FIX_ANY}", "|$0|"), "\\|")
    claimed = F.array_join(F.transform(
        parts, lambda p, i: F.when(i % 2 == 1, _claim(p)).otherwise(p)), "")
    return df.withColumns({
        "_fix_unit": F.when(
            F.col("_fix_num")["end"] == last, F.lower(F.get("_orig", last))),
        "_S2": F.when(_found("_fl") | _found("_fq"), claimed).otherwise(F.col("_S1")),
    })


def extract_quantity(df: DataFrame) -> DataFrame:
    """First unclaimed number with its unit, or an article standing for one."""
    # parts: before, match, marks, number words, words to the unit, unit, after
    df = _find(df, "_S2", QUANTITY, "_q", _has("_S2", "=:?"), 4)
    df = df.withColumns({
        "_q_start": F.when(_found("_q"), _at("_q") + _tokens_in(F.get("_q", F.lit(2)))),
        "_qu_at": F.when(_found("_q") & (F.get("_q", F.lit(5)) != ""), _at("_q") + _tokens_in(
            F.concat(F.get("_q", F.lit(2)), F.get("_q", F.lit(3)), F.get("_q", F.lit(4)),
                     F.lit(",")))),
        "_q_after": _at("_q") + _count("_q"),
        "_S3": _claimed("_S2", "_q"),
    })
    df = df.withColumn("_qn", F.when(_found("_q"), F.get(
        F.filter("_nums", lambda n: n["start"] == F.col("_q_start")), F.lit(0))))
    # "a box of ..." counts one, unless a number or a correction gave a quantity
    df = _find(df, "_S3", ARTICLE, "_a", F.col("_qn").isNull() & F.col("_fix_num").isNull()
               & _has("_S3", "a") & _has("_S3", "u"))
    article = _found("_a")
    unit_at = F.coalesce("_qu_at", _at("_a") + 1)
    number = F.col("_qn")
    df = df.withColumns({
        "_article": article, "_unit_at": unit_at,
        "_after": F.coalesce("_q_after", _at("_a") + _count("_a")),
        "_qty": F.when(article, F.lit(1.0)).otherwise(number["value"]),
        "_vague": F.coalesce(number["vague"], F.lit(False)),
        "_approx": F.coalesce(~number["vague"] & number["approx"], F.lit(False)),
        "_S4": _claimed("_S3", "_a"),
    })
    return df.withColumn("_unit", F.lower(F.get("_orig", F.col("_unit_at"))))


def extract_item(df: DataFrame) -> DataFrame:
    """Item: first free run of one clause after the quantity, else anywhere."""
    cut = F.coalesce(F.col("_after") * _WIDTH, F.lit(0))
    df = df.withColumns({
        "_lead": F.left("_S4", cut), "_tail": F.substr("_S4", cut + 1),
    })
    # the whole string only when nothing is free after the quantity
    df = df.withColumn("_search", F.when(
        F.translate("_tail", "x,;", "") == "", F.col("_S4")).otherwise(F.col("_tail")))
    df = _find(df, "_search", ITEM, "_i", F.translate("_search", "x,;", "") != "")
    at = _at("_i") + F.when(F.length("_search") < F.length("_S4"), F.col("_after")).otherwise(0)
    return df.withColumns({
        "_item": F.when(_found("_i"), F.array_join(
            F.slice("_orig", at + 1, _count("_i")), " ")).otherwise(""),
        "_S5": F.when(_found("_i"), F.concat(
            F.when(F.length("_search") < F.length("_S4"), F.col("_lead")).otherwise(""),
            _claimed("_search", "_i"))).otherwise(F.col("_S4")),
    })


_GAP, _LINK = "\ufdd1", "\ufdd2"  # noncharacters: claimed token, leading conjunction


def extract_description(df: DataFrame) -> DataFrame:
    """Every free run that is left, without leading conjunctions."""
    left = F.translate("_S5", "x,;", "") != ""
    marked = F.zip_with(
        F.regexp_extract_all("_S5", F.lit(".{6}"), F.lit(0)), "_orig",
        lambda c, w: F.when(c.startswith("x"), _GAP)
        .when(F.substring(c, 3, 1) == "c", F.concat(F.lit(_LINK), w)).otherwise(w))
    df = df.withColumn("_runs", F.when(left, F.regexp_extract_all(
        F.array_join(marked, " "), F.lit(f"[^{_GAP}]*[^ {_GAP}][^{_GAP}]*"), F.lit(0))))
    # conjunctions at the head of a run go, elsewhere they stay
    runs = F.transform("_runs", lambda r: F.trim(F.replace(
        F.regexp_replace(F.trim(r), f"^(?:{_LINK}[^ ]*+ ?)++", ""), F.lit(_LINK), F.lit(""))))
    df = df.withColumn("_runs", F.filter(runs, lambda r: r != ""))
    return df.withColumn("_desc", F.when(F.size("_runs") > 0, F.array_join("_runs", ", ")))


def assemble(df: DataFrame) -> DataFrame:
    """Slots after corrections and unit demotion, as the ``parse`` struct."""
    fixed = F.col("_fix_num").isNotNull()
    fix_unit = fixed & F.col("_fix_unit").isNotNull()
    qty = F.when(fixed, F.col("_fix_num")["value"]).otherwise(F.col("_qty"))
    vague = ~fixed & F.col("_vague")
    approx = F.when(fixed, F.col("_fix_num")["approx"]).otherwise(F.col("_approx"))
    demoted = (F.col("_item") == "") & F.col("_unit_at").isNotNull() & ~fix_unit
    item = F.when(demoted, F.get("_orig", F.col("_unit_at"))).otherwise(F.col("_item"))
    unit = F.when(~demoted, F.when(fix_unit, F.col("_fix_unit")).otherwise(F.col("_unit")))
    location = F.coalesce("_fix_loc", "_loc_text")
    overridden = F.array_compact(F.array(
        F.when(F.col("_fix_loc").isNotNull() & (F.col("_loc_text") != ""), "location"),
        F.when(fixed & (F.col("_qty").isNotNull() | F.col("_vague")), "quantity"),
    ))
    certainty = (
        F.when(qty.isNull() & ~vague, 0.0).when(vague, 0.35).when(approx, 0.5)
        .when(F.col("_article"), 0.85).otherwise(1.0)
    )
    return df.withColumn("parse", F.struct(
        item.alias("item_text"), qty.alias("quantity"), unit.alias("unit"),
        location.alias("location_text"), F.col("_desc").alias("description"),
        approx.alias("quantity_approx"), vague.alias("quantity_vague"),
        certainty.alias("cert_quantity"), overridden.alias("overridden"),
    ))


def _slots(df: DataFrame) -> DataFrame:
    for stage in (extract_location, extract_corrections, extract_quantity, extract_item,
                  extract_description, assemble):
        df = stage(df)
    return fence(df.drop(*[c for c in df.columns if c.startswith("_")]), "parse")


def extract(df: DataFrame, text: str = "text", lang: str = "lang",
            extra_units: list[str] | None = None, unit_words: str | None = None) -> DataFrame:
    """One observation per utterance: adds the ``parse`` struct."""
    return _slots(prepare(df, text, lang, extra_units, unit_words))


def per_text(df: DataFrame, work, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``work(texts, text, lang)`` adds, computed once for every different text.

    People repeat themselves: the texts of a table are fewer than its rows, and parsing one
    costs many times what a row costs in the join that hands the result back. ``work`` gets
    the texts of each language, with the names of their two columns. The texts are dealt apart
    from the join, so that its sides stay plain exchanges: Spark can broadcast a small
    one and split a text that most rows say.
    """
    said = df.withColumns({
        "text_key": F.coalesce(text, F.lit("")),
        "lang_key": F.when(F.col(lang) == "es", "es").otherwise("en"),
    })
    texts = dealt(said.select("text_key", "lang_key").distinct(), F.xxhash64("text_key", "lang_key"))
    return said.join(work(texts, "text_key", "lang_key"), ["text_key", "lang_key"], "left").drop(
        "text_key", "lang_key")


# --- several items in one utterance ----------------------------------------

_CUT = (
    f"(?<=[,;]){_cell(kind='c', num=r'[-^]')}[,;]"
    f"(?={_cell(num='[=:?]')}[,;](?:{_CONT}[,;])*+(?:{_cell(unit='u')}|{_ANY * 5}[,;]{_OF})"
    f"|{_cell(kind='a', num=r'[-_^]')}[,;]{_cell(unit='u')})"
)


def split_items(df: DataFrame, text: str = "text", lang: str = "lang",
                extra_units: list[str] | None = None, unit_words: str | None = None) -> DataFrame:
    """One row per item of an utterance: adds ``item_no`` and its ``_norm`` text.

    Cut at conjunctions outside numbers that are followed by a number and a
    unit, a number and "<word> of", or an article and a unit.
    """
    df = prepare(with_norm(df, F.col(text), "_text"), "_text", lang, extra_units, unit_words)
    parts = F.split(F.regexp_replace("_S", _CUT, "|"), "\\|")
    df = df.withColumn("_parts", parts)
    # token offsets: items before, plus one dropped conjunction per cut
    counts = F.transform("_parts", lambda p: _tokens_in(p))
    df = df.withColumn("_counts", counts)
    df = df.withColumn("_words", F.split("_text", " "))
    pieces = F.transform("_counts", lambda n, k: F.array_join(F.slice(
        F.col("_words"),
        F.aggregate(F.slice(F.col("_counts"), 1, k), F.lit(0), lambda a, x: a + x) + k + 1, n), " "))
    df = df.withColumn("_pieces", F.filter(pieces, lambda p: p != ""))
    df = df.withColumn("_pieces", F.when(
        F.size("_pieces") == 0, F.array(F.lit(""))).otherwise(F.col("_pieces")))
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, F.size("_pieces").alias("item_count"),
                     F.posexplode_outer("_pieces").alias("item_no", "_norm"))


def extract_items(df: DataFrame, key: str | list[str], text: str = "text", lang: str = "lang",
                  extra_units: list[str] | None = None,
                  resolver=None, unit_words: str | None = None) -> DataFrame:
    """Every item of an utterance; a later item without location inherits one.

    ``resolver`` is applied before inheritance, so the inherited certainty is
    0.9 per hop of the resolved one. Utterances are bounded by one text, so a
    window per utterance stays small.
    """
    items = split_items(df, text, lang, extra_units, unit_words)
    items = items.withColumn("_norm", F.when(F.col("_norm") == "", "").otherwise(
        F.concat(F.rtrim(F.replace("_norm", F.lit(END), F.lit(","))), F.lit(","))))
    items = _slots(prepare(items, "_norm", lang, extra_units, unit_words))
    if resolver is not None:
        items = resolver(items)
    p = F.col("parse")
    w = Window.partitionBy(key).orderBy("item_no")
    source = F.when(p["location_text"] != "", F.struct(F.col("item_no").alias("no"), p.alias("p")))
    items = items.withColumn("_src", F.last(source, ignorenulls=True).over(w))
    inherits = (p["location_text"] == "") & F.col("_src").isNotNull()
    hops = F.col("item_no") - F.col("_src")["no"]
    carried = p.withField("location_text", F.col("_src")["p"]["location_text"])
    if resolver is not None:
        for name in ("location_id", "location_score"):
            carried = carried.withField(name, F.col("_src")["p"][name])
        carried = carried.withField(
            "cert_location", F.col("_src")["p"]["cert_location"] * F.pow(F.lit(0.9), hops))
    return items.withColumn("parse", F.when(inherits, carried).otherwise(p)).drop("_src")


# --- spoken values and commands --------------------------------------------


def _whole_location(cells: str) -> Column:
    text = F.col(cells)
    return F.when(text.rlike(WHOLE_LOCATION), _render(
        F.col("_cells"), F.size("_fold") - _tokens_in(text), _tokens_in(text)))


def location_value(df: DataFrame, value: str = "value", lang: str = "lang",
                   out: str = "location_text") -> DataFrame:
    """A spoken location on its own: rendered when it is one, else the trimmed text."""
    keep = df.columns
    df = prepare(df, value, lang)
    raw = trim_space(F.coalesce(value, F.lit("")))
    text = F.coalesce(_whole_location("_S"), F.when(F.size("_fold") > 0, raw))
    return fence(df.withColumn(out, text).select(*keep, out), out)


def quantity_value(df: DataFrame, value: str = "value", lang: str = "lang",
                   out: str = "quantity") -> DataFrame:
    """A spoken quantity on its own: the first definite number and its approximation."""
    keep = df.columns
    df = prepare(df, value, lang)
    first = F.get(F.filter("_nums", lambda n: ~n["vague"]), F.lit(0))
    df = df.withColumns({out: first["value"], f"{out}_approx": first["approx"]})
    return fence(df.select(*keep, out, f"{out}_approx"), out, f"{out}_approx")


def commands(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Voice command of an utterance: adds ``command`` ``{kind, field, value}``.

    The order of the tests decides: scratch, confirm, explicit field, negation
    shorthand, reject; null for dictation.
    """
    keep = df.columns
    df = prepare(df, text, lang)
    lg, folds = F.col(lang), F.col("_fold")
    spoken = F.array_join(folds, " ")

    def member(word: Column, attribute: str) -> Column:
        return F.coalesce(in_set(lg, word, attribute), F.lit(False))

    # [change] [article] field [is|to] value
    change = member(F.get(folds, F.lit(0)), "change")
    i = F.when(change, 1).otherwise(0)
    i = i + F.when(member(F.get(folds, i), "articles"), 1).otherwise(0)
    df = df.withColumns({"_change": change, "_field_at": i})
    fields = by_language(lg, lambda t: F.try_element_at(
        F.expr(map_literal(t.fields)), F.get(folds, F.col("_field_at"))))
    follow = F.get(folds, F.col("_field_at") + 1)
    df = df.withColumns({"_field": fields, "_sep": member(follow, "is_words") | member(
        follow, "to_words")})
    at = F.col("_field_at") + F.when(F.col("_sep"), 2).otherwise(1)
    df = df.withColumn("_value", F.when(
        F.col("_field").isNotNull() & (F.col("_sep") | F.col("_change")) & (F.size(folds) > at),
        F.array_join(F.slice("_orig", at + 1, F.size(folds)), " ")))

    # negation at the start, then the rest as a value of its own
    rest = F.regexp_replace("_S", f"^{_NEGATION}[,;]", "")
    df = df.withColumn("_rest", F.when(F.col("_S").rlike(f"^{_NEGATION}[,;]"), rest))
    df = df.withColumn("_loc_value", F.when(F.col("_rest") != "", _whole_location("_rest")))
    start = F.size(folds) - _tokens_in(F.col("_rest"))
    number = F.get(F.filter("_nums", lambda n: (n["mark_start"] == start)
                            | (n["start"] == start)), F.lit(0))
    df = df.withColumn("_qty_value", F.when(
        (F.col("_rest") != "") & F.col("_rest").rlike(WHOLE_QUANTITY),
        format_quantity(number["value"])))

    def command(kind, field=None, value=None) -> Column:
        text_or_null = lambda v: F.lit(v).cast("string") if not isinstance(v, Column) else v
        return F.struct(F.lit(kind).alias("kind"), text_or_null(field).alias("field"),
                        text_or_null(value).alias("value"))

    rejects = by_language(lg, lambda t: all_in(folds, t.reject))
    found = (
        F.when(by_language(lg, lambda t: spoken.isin(*t.scratch)), command("scratch"))
        .when(by_language(lg, lambda t: all_in(folds, t.confirm)), command("confirm"))
        .when(F.col("_value").isNotNull(), command("set_field", F.col("_field"), F.col("_value")))
        .when(F.col("_loc_value").isNotNull(), command("set_field", "location", F.col("_loc_value")))
        .when(F.col("_qty_value").isNotNull(), command("set_field", "quantity", F.col("_qty_value")))
        .when(rejects, command("reject"))
    )
    return fence(df.withColumn("command", found).select(*keep, "command"), "command")
