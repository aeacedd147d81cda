"""SQL surface: temporary SQL functions for the text rules."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyline.functions.text import ACCENTED, PLAIN


def register(spark: SparkSession) -> None:
    """Register ``fold``, ``canon_code`` and ``similarity`` for SQL users."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fold(s STRING) RETURNS STRING "
        f"RETURN translate(lower(s), '{ACCENTED}', '{PLAIN}')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION canon_code(s STRING) RETURNS STRING "
        f"RETURN translate(translate(lower(s), '{ACCENTED}', '{PLAIN}'), ' -./', '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION similarity(a STRING, b STRING) RETURNS DOUBLE "
        "RETURN if(greatest(length(a), length(b)) = 0, 1.0D, "
        "1 - levenshtein(a, b) / greatest(length(a), length(b)))"
    )
