"""Backend unit words ahead of extraction: a distributed dictionary join.

The words of all utterances meet the unit table of their language in an equi-join, and each
utterance gets the unit words it says. The table is never brought to the driver nor
written into an expression, so it may be as large as the sites make it; whether it is
broadcast is Spark's choice by measured size. Built-in units are left out beforehand:
they answer first, and they are the words most utterances share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import fold
from tallyline.lexicon import builtin_unit, unit_forms
from tallyline.operators import extraction
from tallyline.operators.tokens import with_norm, with_tokens


def _no_units() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def said_words(df: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Folded words of every utterance that no built-in unit answers: ``(key, lang, word)``, each once."""
    row_lang = F.when(F.col(lang) == "es", "es").otherwise("en")
    tokens = with_tokens(with_norm(df.select(key, F.col(lang).alias("_lang"), row_lang.alias("_ul"),
                                             F.col(text).alias("_said")), F.col("_said")))
    words = F.filter(F.array_distinct("_fold"), lambda w: w.rlike("[a-z]"))
    return (tokens.select(key, "_lang", "_ul", F.explode(words).alias("_uf"))
            .where(builtin_unit(F.col("_lang"), F.col("_uf")).isNull()).select(key, "_ul", "_uf"))


def with_unit_words(df: DataFrame, units: DataFrame, key: str, text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """Add ``unit_forms``, the backend units an utterance says (form to canonical name), and
    ``unit_words``, its forms.

    ``key`` names a column that tells utterances apart and is never null. ``units``
    has ``name``, ``aliases`` and ``language``; a null or empty language is every language.
    """
    entry = F.struct(F.col("_uf"), F.col("_canonical"))
    found = (said_words(df, key, text, lang).join(unit_forms(units), ["_ul", "_uf"])
             .groupBy(key).agg(F.map_from_entries(F.collect_set(entry)).alias("unit_forms")))
    return (df.join(found, key, "left")
            .withColumn("unit_forms", F.coalesce("unit_forms", _no_units()))
            .withColumn("unit_words", F.map_keys("unit_forms")))


def extract_with_units(df: DataFrame, units: DataFrame, key: str, text: str = "text",
                       lang: str = "lang") -> DataFrame:
    """``extract`` with the built-in and the backend units; adds ``canonical_unit`` of the unit found."""
    parsed = extraction.extract(with_unit_words(df, units, key, text, lang), text, lang, unit_words="unit_words")
    unit = fold(F.col("parse")["unit"])
    return parsed.withColumn("canonical_unit", F.coalesce(
        builtin_unit(F.col(lang), unit), F.try_element_at("unit_forms", unit))).drop("unit_forms", "unit_words")
