"""Fixed schemas. Readers always get one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

S, D, B, TS, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(*f) for f in fields])


PARSED = _struct(
    ("item_text", S, False),
    ("part_number", S),
    ("quantity", D),
    ("unit", S),
    ("location_text", S, False),
    ("location_id", S),
    ("description", S),
)

CONFIDENCE = _struct(("asr", D), ("quantity", D), ("location", D), ("item", D))

CORRECTION = _struct(("field", S), ("from", S), ("to", S), ("at", TS))

OBSERVATION = _struct(
    ("id", S),
    ("device_id", S),
    ("operator_id", S),
    ("captured_at", TS),
    ("language", S),
    ("raw_transcript", S),
    ("audio_ref", S),
    ("parsed", PARSED),
    ("confidence", CONFIDENCE),
    ("status", S),
    ("corrections", T.ArrayType(CORRECTION)),
    ("needs_review", B),
    ("review_reasons", T.ArrayType(S)),
    ("sync_rejected_reason", S),
    ("sync_rejected_at", TS),
    ("schema_version", I),
)

# store-side columns on top of the wire record
OBSERVATION_ROW = T.StructType(
    OBSERVATION.fields
    + _struct(("created_at", TS), ("updated_at", TS), ("synced_at", TS)).fields
)

CORRECTION_LOG = _struct(
    ("observation_id", S), ("seq", T.LongType()), ("field", S),
    ("from_value", S), ("to_value", S), ("at", TS),
)

LOCATION = _struct(("id", S), ("name", S), ("aliases", T.ArrayType(S)))
PART = _struct(("part_number", S), ("name", S), ("aliases", T.ArrayType(S)))
UNIT = _struct(("name", S), ("language", S), ("aliases", T.ArrayType(S)))
REFDATA = _struct(
    ("locations", T.ArrayType(LOCATION)),
    ("parts", T.ArrayType(PART)),
    ("units", T.ArrayType(UNIT)),
)

BATCH = _struct(("device_id", S), ("observations", T.ArrayType(OBSERVATION)))
VOID_REQUEST = _struct(("device_id", S), ("ids", T.ArrayType(S)))
PUSH_RESPONSE = _struct(
    ("accepted", T.ArrayType(S)),
    ("rejected", T.ArrayType(_struct(("id", S), ("reason", S)))),
)

_OFFSETS = _struct(("from", I), ("to", I))
TRANSCRIPT = _struct(
    ("result", _struct(("language", S))),
    ("transcription", T.ArrayType(_struct(
        ("text", S),
        ("offsets", _OFFSETS),
        ("tokens", T.ArrayType(_struct(("text", S), ("p", D), ("offsets", _OFFSETS)))),
    ))),
)

PROFILE = _struct(
    ("device_id", S), ("operator_id", S), ("language", S), ("capture_mode", S),
    ("asr_threshold", D), ("quantity_threshold", D), ("location_threshold", D),
    ("item_threshold", D), ("auto_confirm", B), ("required_fields", T.ArrayType(S)),
    ("multi_item", B), ("target_latency_ms", I), ("high_pass_hz", I),
    ("keep_days", I), ("batch_size", I),
)
