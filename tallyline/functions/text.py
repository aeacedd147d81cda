"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accent map of the text folding.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"

# The white space that separates words: the Unicode property, not only ASCII.
SPACE = r"(?U)\s"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def fold(c) -> Column:
    """Lower-case and strip the accents of the fixed map; punctuation stays."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


def strip_separators(c) -> Column:
    """Drop the separators of an already folded code."""
    return F.translate(col(c), " -./", "")


def canon_code(c) -> Column:
    """Comparison form of a location code: ``A-14`` = ``a 14`` = ``a14``."""
    return strip_separators(fold(c))


def depluralize(c) -> Column:
    """Strip a simple plural suffix from every word; byte lengths decide."""
    words = F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")

    def singular(w: Column) -> Column:
        size = F.octet_length(w)
        return (
            F.when(w.endswith("es") & (size > 4), F.left(w, F.length(w) - 2))
            .when(w.endswith("s") & (size > 3), F.left(w, F.length(w) - 1))
            .otherwise(w)
        )

    return F.array_join(F.transform(words, singular), " ")


def is_code(c) -> Column:
    """A folded word mixing letters and digits, such as ``a-14`` or ``c7``."""
    return col(c).rlike("^(?=.*[a-z])(?=.*[0-9])[a-z0-9-]{1,10}$")


def code_display(c) -> Column:
    """Upper-case a code, with a dash at its first letter-digit boundary."""
    up = F.upper(col(c))
    return F.when(up.contains("-"), up).otherwise(
        F.regexp_replace(up, "^(.*?[A-Z])([0-9].*)$", "$1-$2")
    )


def is_number(c) -> Column:
    """A word ``parse_digits`` has a value for."""
    c = col(c)
    # the pattern first: most words fail it cheaply
    return c.rlike(
        r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+,[0-9]*|,[0-9]+)$"
    ) & parse_digits(c).isNotNull()


def parse_digits(c) -> Column:
    """Value of a numeric word: ``14``, ``12.5``, ``12,5``, ``1,200``; else null."""
    c = col(c)
    text = (
        F.when(c.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), c)
        .when(c.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(c, F.lit(","), F.lit("")))
        .when(c.rlike(r"^([0-9]+,[0-9]*|,[0-9]+)$"), F.replace(c, F.lit(","), F.lit(".")))
    )
    value = text.try_cast("double")
    return F.when(value < F.lit(float("inf")), value)


def format_quantity(c) -> Column:
    """Minimal decimal form without exponent, over all doubles; null becomes the empty string.

    The fewest of 15, 16 or 17 digits that read back as the same number.
    """
    c = col(c).cast("double")
    by_digits = [F.format_string(f"%.{n}e", c) for n in (14, 15, 16)]
    shown = F.coalesce(*[F.when(x.try_cast("double") == c, x) for x in by_digits], c.cast("string"))
    parts = r"^(-?)([0-9])\.([0-9]*?)0*e([+-][0-9]+)$"

    def once(value: Column, build) -> Column:
        """``build`` of a value that is computed a single time."""
        return F.get(F.transform(F.array(value), build), F.lit(0))

    def moved(text: Column) -> Column:
        """The digits, moved by the exponent."""
        def place(x: Column) -> Column:
            digits, shift = x["digits"], x["shift"]
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift - 1), digits)
            split = F.concat(F.substring(digits, F.lit(1), shift + 1), F.lit("."),
                             F.substring(digits, shift + 2, F.length(digits)))
            whole = F.rpad(digits, shift + 1, F.lit("0"))
            return F.concat(x["sign"], F.when(shift < 0, small).when(
                F.length(digits) <= shift + 1, whole).otherwise(split))

        found = F.struct(
            F.regexp_extract(text, parts, 1).alias("sign"),
            F.concat(F.regexp_extract(text, parts, 2), F.regexp_extract(text, parts, 3)).alias("digits"),
            F.regexp_extract(text, parts, 4).try_cast("int").alias("shift"))
        return F.when(text.rlike(parts), once(found, place)).otherwise(text)

    short = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.coalesce(
        F.when(short, c.cast("bigint").cast("string"))
        .otherwise(once(shown, moved)),
        F.lit(""),
    )


def clamp01(c) -> Column:
    """Into 0 to 1; a value that is not a number stays one, for the record checks to refuse."""
    c = col(c)
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def all_in(tokens: Column, words) -> Column:
    """Every token belongs to the word set; false for no tokens."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*words))


def rfc3339_seconds(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_nanos(c) -> Column:
    """Fixed-width nine-digit fraction, so text order is time order."""
    return F.concat(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def parse_rfc3339(c) -> Column:
    """Timestamp of an RFC 3339 text; digits past the microsecond are cut."""
    cut = F.regexp_replace(col(c), r"(\.[0-9]{6})[0-9]+", "$1")
    return cut.try_cast("timestamp")


def string_array_json(c) -> Column:
    """JSON text of a string array; null encodes as ``null``."""
    return F.coalesce(F.to_json(col(c)), F.lit("null"))


def string_array_from_json(c) -> Column:
    """Array of a JSON text; ``null`` and broken text decode to an empty array."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


# The read-back phrases.
READBACK = {
    "en": ("no quantity", "no item", "no location", ". Correct?"),
    "es": ("sin cantidad", "sin artículo", "sin ubicación", ". ¿Correcto?"),
}


def readback(quantity, unit, item, location, lang) -> Column:
    """The confirmation line shown to the operator."""
    quantity, unit, item, location, lang = map(col, (quantity, unit, item, location, lang))

    def phrase(k: int) -> Column:
        return F.when(lang == "es", F.lit(READBACK["es"][k])).otherwise(F.lit(READBACK["en"][k]))

    amount = F.when(
        quantity.isNotNull(), F.concat_ws(" ", format_quantity(quantity), unit)
    ).otherwise(phrase(0))
    return F.concat(
        amount, F.lit(", "),
        F.when(item != "", item).otherwise(phrase(1)), F.lit(", "),
        F.when(location != "", location).otherwise(phrase(2)),
        phrase(3),
    )
