"""Confidence, review flags and confirmation rules of captured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import clamp01

# The default profile.
DEFAULT_PROFILE = {
    "asr_threshold": 0.70, "quantity_threshold": 0.70, "location_threshold": 0.70,
    "item_threshold": 0.60, "auto_confirm": False,
    "required_fields": ["item", "quantity", "location"],
    "keep_days": 7, "target_latency_ms": 3000, "batch_size": 50, "multi_item": False,
    "high_pass_hz": 100,
}

# Fixed value: reason of a capped utterance.
TRUNCATED = "utterance hit the 30-second cap; tail may be missing"


def _default(name: str) -> Column:
    value = DEFAULT_PROFILE[name]
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def with_profile(df: DataFrame, profiles: DataFrame | None = None,
                 device: str = "device_id") -> DataFrame:
    """Add the profile settings of the record's device, else the defaults."""
    names = list(DEFAULT_PROFILE)
    if profiles is None:
        return df.withColumns({n: _default(n) for n in names})
    p = profiles.select(F.col("device_id").alias("_pd"), *[F.col(n).alias(f"_p_{n}") for n in names])
    joined = df.join(p, F.col(device) == F.col("_pd"), "left")
    return joined.withColumns({n: F.coalesce(f"_p_{n}", _default(n)) for n in names}).drop(
        "_pd", *[f"_p_{n}" for n in names])


def confidence(cert_quantity, cert_location, cert_item, asr) -> Column:
    """Parse certainty times speech confidence, clamped, per slot."""
    return F.struct(
        clamp01(asr).alias("asr"), clamp01(cert_quantity * asr).alias("quantity"),
        clamp01(cert_location * asr).alias("location"), clamp01(cert_item * asr).alias("item"),
    )


def _required(name: str) -> Column:
    return F.array_contains("required_fields", name)


def _threshold_reasons(p: Column, c: Column) -> list[Column]:
    return [
        F.when((c["asr"] > 0) & (c["asr"] < F.col("asr_threshold")), "low speech confidence"),
        F.when(p["quantity"].isNotNull() & (c["quantity"] < F.col("quantity_threshold")),
               "low quantity confidence"),
        F.when((p["location_text"] != "") & (c["location"] < F.col("location_threshold")),
               "low location confidence"),
        F.when((p["item_text"] != "") & (c["item"] < F.col("item_threshold")),
               "low item confidence"),
    ]


def capture_reasons(p: Column, c: Column, vague: Column, truncated: Column,
                    has_locations: bool, has_parts: bool) -> Column:
    """Review reasons of a fresh record, in fixed order."""
    missing_quantity = p["quantity"].isNull() & _required("quantity")
    return F.array_compact(F.array(
        F.when((p["item_text"] == "") & _required("item"), "no item"),
        F.when(missing_quantity, F.when(vague, "vague quantity").otherwise("no quantity spoken")),
        F.when((p["location_text"] == "") & _required("location"), "no location spoken"),
        *_threshold_reasons(p, c),
        F.when((p["location_text"] != "") & p["location_id"].isNull() & F.lit(has_locations),
               "location not in known locations"),
        F.when((p["item_text"] != "") & p["part_number"].isNull() & F.lit(has_parts),
               "item not in part vocabulary"),
        F.when(truncated, TRUNCATED),
    ))


def edit_reasons(p: Column, c: Column) -> Column:
    """Review reasons of an edited record: no vague and no unresolved reasons."""
    return F.array_compact(F.array(
        F.when((p["item_text"] == "") & _required("item"), "no item"),
        F.when(p["quantity"].isNull() & _required("quantity"), "no quantity spoken"),
        F.when((p["location_text"] == "") & _required("location"), "no location spoken"),
        *_threshold_reasons(p, c),
    ))


def doubtful(p: Column, c: Column) -> Column:
    """Fields missing or below their threshold."""
    return F.array_compact(F.array(
        F.when(p["quantity"].isNull() | (c["quantity"] < F.col("quantity_threshold")), "quantity"),
        F.when((p["location_text"] == "") | (c["location"] < F.col("location_threshold")),
               "location"),
        F.when((p["item_text"] == "") | (c["item"] < F.col("item_threshold")), "item"),
    ))


def capture_status(needs_review: Column, item_no: Column, item_count: Column) -> Column:
    """All but the last item confirm at once; the last one if opted in and clean."""
    last = item_no == item_count - 1
    return F.when(~last | (F.col("auto_confirm") & ~needs_review), "confirmed").otherwise("draft")


def review_records(df: DataFrame, profiles: DataFrame | None, has_locations: bool,
                   has_parts: bool, parse: str = "parse") -> DataFrame:
    """Confidence, reasons and status of parsed utterances."""
    p = F.col(parse)
    df = with_profile(df, profiles)
    df = df.withColumn("confidence", confidence(
        p["cert_quantity"], p["cert_location"], p["cert_item"], F.col("asr_confidence")))
    df = df.withColumn("review_reasons", capture_reasons(
        p, F.col("confidence"), p["quantity_vague"], F.col("truncated"),
        has_locations, has_parts))
    return df.withColumn("needs_review", F.size("review_reasons") > 0).withColumn(
        "doubtful", doubtful(p, F.col("confidence")))


def profile_problem() -> Column:
    """First broken rule of a device profile; null for a valid one."""
    bad_field = F.get(F.filter(F.col("required_fields"), lambda f: ~f.isin(
        "item", "quantity", "location", "unit", "description")), F.lit(0))
    bad_threshold = F.get(F.filter(F.array(
        "asr_threshold", "quantity_threshold", "location_threshold", "item_threshold"),
        lambda t: (t < 0) | (t > 1)), F.lit(0))
    return F.coalesce(
        F.when(~F.col("language").isin("en", "es", "auto"), "unsupported language"),
        F.when(~F.col("capture_mode").isin("ptt", "wake"), "unsupported capture mode"),
        F.when(F.col("keep_days") < 0, "keep_days is negative"),
        F.when(F.col("batch_size") < 0, "batch_size is negative"),
        F.when(F.col("high_pass_hz") < 0, "high_pass_hz is negative"),
        F.when(bad_threshold.isNotNull(), "threshold out of range"),
        F.when(bad_field.isNotNull(), "unknown required field"),
    )
