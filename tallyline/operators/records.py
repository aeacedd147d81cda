"""Record table operators: filters, lifecycle, merge, tombstones, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import format_quantity, rfc3339_seconds
from tallyline.operators.ordered import numbered

STATUSES = ("draft", "confirmed", "synced", "rejected")
# The legal moves of a record.
MOVES = (("draft", "confirmed"), ("draft", "rejected"),
         ("confirmed", "synced"), ("confirmed", "rejected"))

# The export columns, in order.
CSV_COLUMNS = (
    "id captured_at operator_id device_id quantity unit item_text part_number location_text "
    "location_id status needs_review sync_rejected_reason description raw_transcript"
).split()


# --- filters ---------------------------------------------------------------


def list_records(df: DataFrame, status: str | None = None, needs_review: bool | None = None,
                 sync_rejected: bool | None = None, limit: int | None = None,
                 offset: int = 0) -> DataFrame:
    """Newest first, with optional filters and paging; an offset alone is allowed."""
    if status:
        df = df.where(F.col("status") == status)
    if needs_review is not None:
        df = df.where(F.col("needs_review") == needs_review)
    if sync_rejected is not None:
        badge = F.col("sync_rejected_reason")
        df = df.where(badge.isNotNull() if sync_rejected else badge.isNull())
    df = df.orderBy(F.desc("id"))
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def get_records(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted id, with ``found`` and, if it exists, the record."""
    ids = wanted.select(F.col("id").alias("_want")).distinct()
    return ids.join(df, F.col("_want") == F.col("id"), "left").withColumn(
        "found", F.col("id").isNotNull()).withColumn("id", F.col("_want")).drop("_want")


def unsynced(df: DataFrame, after: str = "", limit: int = 50) -> DataFrame:
    """One page of the push queue, by keyset cursor."""
    return df.where((F.col("status") == "confirmed") & (F.col("id") > after)).orderBy("id").limit(limit)


def push_batches(df: DataFrame, size: int = 50) -> DataFrame:
    """Batch number of every queued record, oldest first per device."""
    queue = df.where("status = 'confirmed'")
    return numbered(queue, ["device_id"], "id", "position").withColumn(
        "batch_no", F.floor((F.col("position") - 1) / size).cast("bigint"))


def audio_to_purge(df: DataFrame, now: Column, keep_days) -> DataFrame:
    """Synced records with audio older than the retention, strictly."""
    days = F.greatest(F.lit(0), keep_days if isinstance(keep_days, Column) else F.lit(keep_days))
    cutoff = now - F.make_dt_interval(days=days)
    return df.where((F.col("status") == "synced") & F.col("audio_ref").isNotNull()
                    & (F.col("synced_at") < cutoff)).select("id", "audio_ref")


def clear_audio(df: DataFrame, purged: DataFrame) -> DataFrame:
    gone = purged.select(F.col("id").alias("_pid")).distinct()
    return df.join(gone, F.col("id") == F.col("_pid"), "left").withColumn(
        "audio_ref", F.when(F.col("_pid").isNull(), F.col("audio_ref"))).drop("_pid")


# --- validation and lifecycle ----------------------------------------------

_HEX = "[0-9a-fA-F]"
_DASHED = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
# plain, as a URN, in braces, or without dashes
_UUID = f"^(?:{_DASHED}|(?i:urn:uuid:){_DASHED}|\\{{{_DASHED}\\}}|{_HEX}{{32}})$"

# The messages of the record checks, in the order of the checks.
INVALID = {
    "id": "invalid id",
    "captured_at": "captured_at is zero",
    "status": "invalid status",
    "language": "language is empty",
    "schema_version": "schema_version must be positive",
    "infinite": "quantity is not a finite number",
    "negative": "quantity is negative",
    "confidence": "confidence.{} out of range",
}


def invalid_reason(quantity="parsed.quantity", confidence="confidence") -> Column:
    """First broken structural rule of a record; null for a valid one."""
    q = F.col(quantity)

    def out_of_range(name: str) -> Column:
        c = F.col(f"{confidence}.{name}")
        return F.when((c < 0) | (c > 1) | F.isnan(c), INVALID["confidence"].format(name))

    infinite = F.isnan(q) | (F.abs(q) == float("inf"))
    return F.coalesce(
        F.when(~F.coalesce(F.col("id").rlike(_UUID), F.lit(False)), INVALID["id"]),
        F.when(F.col("captured_at").isNull(), INVALID["captured_at"]),
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), INVALID["status"]),
        F.when(F.coalesce(F.col("language"), F.lit("")) == "", INVALID["language"]),
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) <= 0,
               INVALID["schema_version"]),
        F.when(infinite, INVALID["infinite"]),
        F.when(q < 0, INVALID["negative"]),
        *[out_of_range(n) for n in ("asr", "quantity", "location", "item")],
    )


def can_move(current: Column, target: Column) -> Column:
    legal = F.lit(False)
    for a, b in MOVES:
        legal = legal | ((current == a) & (target == b))
    return legal


def apply_moves(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Outcome of requested status moves ``(id, to_status)``, one per record."""
    base = df.select("id", "status")
    joined = moves.join(base, "id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "not_found")
        .when(can_move(F.col("status"), F.col("to_status")), "applied")
        .otherwise("bad_transition")
    )
    return joined.withColumn("outcome", outcome).withColumn(
        "new_status", F.when(F.col("outcome") == "applied", F.col("to_status"))
        .otherwise(F.col("status")))


# --- sync ------------------------------------------------------------------


def mark_synced(df: DataFrame, accepted: DataFrame, at: Column) -> DataFrame:
    """Accepted records that are still confirmed become synced; their badge clears."""
    ids = accepted.select(F.col("id").alias("_aid")).distinct()
    hit = F.col("_aid").isNotNull() & (F.col("status") == "confirmed")
    return df.join(ids, F.col("id") == F.col("_aid"), "left").withColumn("_hit", hit).withColumns({
        "status": F.when(F.col("_hit"), "synced").otherwise(F.col("status")),
        "synced_at": F.when(F.col("_hit"), at).otherwise(F.col("synced_at")),
        "sync_rejected_reason": F.when(~F.col("_hit"), F.col("sync_rejected_reason")),
        "sync_rejected_at": F.when(~F.col("_hit"), F.col("sync_rejected_at")),
    }).withColumnRenamed("_hit", "newly_synced").drop("_aid")


def diverged(df: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted ids that were rejected locally while the push was under way."""
    rejected = df.where("status = 'rejected'").select("id")
    return accepted.select("id").distinct().join(rejected, "id", "left_semi")


def reject_badges(df: DataFrame, refusals: DataFrame, at: Column) -> DataFrame:
    """Refusal reason and time on confirmed records; the status does not change."""
    r = refusals.groupBy(F.col("id").alias("_rid")).agg(F.max("reason").alias("_reason"))
    hit = F.col("_rid").isNotNull() & (F.col("status") == "confirmed")
    return df.join(r, F.col("id") == F.col("_rid"), "left").withColumns({
        "sync_rejected_reason": F.when(hit, F.col("_reason")).otherwise(
            F.col("sync_rejected_reason")),
        "sync_rejected_at": F.when(hit, at).otherwise(F.col("sync_rejected_at")),
    }).drop("_rid", "_reason")


def pending_voids(saved: DataFrame, fresh: DataFrame, acked: DataFrame) -> DataFrame:
    """Voids still to send: saved and fresh ones, without the acknowledged."""
    return saved.select("id").unionByName(fresh.select("id")).distinct().join(
        acked.select("id").distinct(), "id", "left_anti")


def dedupe(df: DataFrame, key: str, position: str) -> DataFrame:
    """First occurrence of every key, keeping the order position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def upsert(base: DataFrame, batch: DataFrame, arrival: str, key: str = "id",
           owner: str = "device_id") -> DataFrame:
    """Idempotent merge: of a key's rows the last to arrive wins.

    A record belongs to its device in the base, or else to the device whose row
    arrived first; rows of another device never replace it. ``arrival`` orders
    the rows of the batch (a number without ties, such as batch and position);
    rows of the base came before all of them.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in base.columns])
    came = F.struct("_new", F.col(arrival).alias("_at"))
    # partial aggregation per owner first, so a much re-sent record stays small
    per_owner = both.groupBy(key, owner).agg(
        F.max_by(row, came).alias("_row"), F.min(came).alias("_first"))
    best = per_owner.groupBy(key).agg(F.min_by("_row", F.struct("_first", owner)).alias("_row"))
    return best.select("_row.*")


def upsert_bucketed(base: DataFrame, batch: DataFrame, arrival: str, key: str = "id",
                    owner: str = "device_id") -> DataFrame:
    """``upsert`` into records kept bucketed by key (``sources.write_bucketed``), which stay where they are.

    Only the batch is shuffled: its rows become one claim per key and device, claims meet the
    owners in the base bucket by bucket, and what wins replaces its record. The base has one
    row a key; keys are not null (``invalid_reason`` rejects such rows).
    """
    claims = batch.groupBy(key, owner).agg(
        F.max_by(F.struct(*[F.col(c) for c in base.columns]), arrival).alias("_row"), F.min(arrival).alias("_first"))
    owners = base.select(key, F.col(owner).alias("_mine"), F.lit(True).alias("_known"))
    won = (claims.join(owners, key, "left")
           .where(F.col("_known").isNull() | F.col("_mine").eqNullSafe(F.col(owner)))
           .groupBy(key).agg(F.min_by("_row", F.struct("_first", owner)).alias("_row")))
    old = base.select(key, F.struct(*[F.col(c) for c in base.columns]).alias("_old"))
    return old.join(won, key, "full").select(F.coalesce("_row", "_old").alias("_row")).select("_row.*")


def apply_voids(df: DataFrame, voids: DataFrame) -> DataFrame:
    """Records without the tombstoned ids, in whatever order both arrived."""
    return df.join(voids.select("id").distinct(), "id", "left_anti")


# --- corrections -----------------------------------------------------------


def number_corrections(log: DataFrame) -> DataFrame:
    """Sequence number of each correction within its record."""
    # a record's log is bounded by what a person edits
    order = Window.partitionBy("observation_id").orderBy("at", "pos")
    return log.withColumn("seq", F.row_number().over(order).cast("bigint"))


def attach_corrections(df: DataFrame, log: DataFrame) -> DataFrame:
    """Add ``corrections``, each record's log in sequence order."""
    nested = log.groupBy(F.col("observation_id").alias("_oid")).agg(F.array_sort(F.collect_list(
        F.struct("seq", "field", "from_value", "to_value", "at"))).alias("_c"))
    empty = F.array().cast(nested.schema["_c"].dataType)
    return df.join(nested, F.col("id") == F.col("_oid"), "left").withColumn(
        "corrections", F.coalesce("_c", empty)).drop("_oid", "_c")


def latest_corrections(log: DataFrame) -> DataFrame:
    """Last value of every corrected field, by time and position in the log."""
    return log.groupBy("observation_id", "field").agg(
        F.max_by("to_value", F.struct("at", "pos")).alias("to_value"))


# --- export ----------------------------------------------------------------


def csv_rows(df: DataFrame) -> DataFrame:
    """The fixed export columns as text; null becomes the empty string."""
    def source(name: str) -> Column:
        if name == "captured_at":
            return rfc3339_seconds("captured_at")
        if name == "quantity":
            return format_quantity("parsed.quantity")
        if name == "needs_review":
            return F.col("needs_review").cast("string")
        if name in ("unit", "item_text", "part_number", "location_text", "location_id",
                    "description"):
            return F.col(f"parsed.{name}")
        return F.col(name)
    return df.select(*[F.coalesce(source(n), F.lit("")).alias(n) for n in CSV_COLUMNS])


# The messages of the claim checks, in the order of the checks.
CLAIMS = ("unexpected protocol", "token expired", "claims do not match payload",
          "payload does not match the digest")


def claims_problem(now: Column, protocol: str) -> Column:
    """First broken rule of a signed message's claims; null when they hold.

    What is missing does not match; only an expiry may be absent.
    """
    c = F.col("claims")

    def differs(a: Column, b: Column) -> Column:
        return a.isNull() | b.isNull() | ~a.eqNullSafe(b)

    return F.coalesce(
        F.when(differs(F.col("protocol"), F.lit(protocol)), CLAIMS[0]),
        F.when(now > c["expires_at"], CLAIMS[1]),
        F.when(differs(c["id"], F.col("id")) | differs(c["device_id"], F.col("device_id"))
               | differs(c["operator_id"], F.col("operator_id")), CLAIMS[2]),
        F.when(differs(c["sha256"], F.sha2("payload", 256)), CLAIMS[3]),
    )
