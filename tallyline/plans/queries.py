"""Registered queries and their SQL counterparts.

Each entry runs an operator over whole tables. Where plain SQL can state the
same result, ``ORACLES`` holds it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import lexicon, sources
from tallyline.functions import similarity as sim
from tallyline.functions import text as tx
from tallyline.operators import analytics as an
from tallyline.operators import edits as ed
from tallyline.operators import extraction as ex
from tallyline.operators import frames as fr
from tallyline.operators import records as rec
from tallyline.operators import review as rv
from tallyline.operators import vocabulary as voc
from tallyline.operators.resolve import match_texts, reference_keys, resolve, resolve_parse
from tallyline.operators.tokens import tokenize as tokenize_text
from tallyline.plans.corpus import (
    LOG_SQL, OBS_SQL, PARTS_SQL, UTT_SQL, correction_log, dealt, location_dimension, observations,
    orders_with_parts, part_dimension, table, utterances,
)
from tallyline.session import cut_lineage, shared_dir, tasks_for
from tallyline.streaming import ingest, segments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, obs: bool = False, log: bool = False, utt: bool = False,
          parts: bool = False):
    """Register a query; the flags prepend the corpus the SQL reads."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ctes = [c for on, c in ((obs or log, OBS_SQL), (log, LOG_SQL), (utt, UTT_SQL),
                                    (parts, PARTS_SQL)) if on]
            ORACLES[fn.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return fn
    return register


def _epoch(c: str, name: str):
    return F.unix_seconds(F.col(c)).alias(name)


def now():
    """A fixed present, 2000-01-01, inside the data's range."""
    return F.timestamp_seconds(F.lit(946684800))


# --- records ---------------------------------------------------------------


@query("""SELECT id, device_id, operator_id, epoch(captured_at)::BIGINT AS captured, language,
  audio_ref, quantity, unit, item_text, location_text, location_id, round(c_asr, 6) AS conf_asr,
  status, needs_review, sync_rejected_reason FROM obs""", obs=True)
def obs_scan(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select(
        "id", "device_id", "operator_id", _epoch("captured_at", "captured"), "language",
        "audio_ref", "parsed.quantity", "parsed.unit", "parsed.item_text", "parsed.location_text",
        "parsed.location_id", F.round("confidence.asr", 6).alias("conf_asr"), "status",
        "needs_review", "sync_rejected_reason")


@query("""SELECT id, status FROM obs WHERE status = 'confirmed' AND needs_review
  AND sync_rejected_reason IS NULL ORDER BY id DESC LIMIT 100""", obs=True)
def list_filter(spark, d):
    return rec.list_records(observations(spark, d), "confirmed", True, False, limit=100).select(
        "id", "status")


@query("SELECT id FROM obs ORDER BY id DESC LIMIT 25 OFFSET 50", obs=True)
def list_page(spark, d):
    return rec.list_records(observations(spark, d), limit=25, offset=50).select("id")


@query("""SELECT id, true AS found, status, item_text FROM obs WHERE id = (SELECT max(id) FROM obs)
  UNION ALL SELECT max(id) || 'x', false, NULL, NULL FROM obs""", obs=True)
def obs_get(spark, d):
    df = observations(spark, d)
    newest = df.agg(F.max("id").alias("id"))
    # of two wanted ids one is not there: its row is found without a record
    wanted = newest.unionAll(newest.select(F.concat("id", F.lit("x"))))
    return rec.get_records(df, wanted).select("id", "found", "status", "parsed.item_text")


@query("""SELECT id FROM obs WHERE status = 'confirmed' AND id > '00c0' ORDER BY id LIMIT 50""",
       obs=True)
def unsynced_queue(spark, d):
    return rec.unsynced(observations(spark, d), after="00c0").select("id")


@query("""SELECT id, device_id, (row_number() OVER (PARTITION BY device_id ORDER BY id) - 1) // 50
  AS batch_no FROM obs WHERE status = 'confirmed'""", obs=True)
def push_batches(spark, d):
    return rec.push_batches(observations(spark, d)).select("id", "device_id", "batch_no")


@query("""SELECT id, audio_ref FROM obs WHERE status = 'synced' AND audio_ref IS NOT NULL
  AND synced_at < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY""", obs=True)
def audio_purge(spark, d):
    return rec.audio_to_purge(observations(spark, d), now(), 7)


@query("""SELECT id, CASE WHEN NOT (status = 'synced' AND audio_ref IS NOT NULL
  AND synced_at < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY) OR synced_at IS NULL
  THEN audio_ref END AS audio_ref FROM obs""", obs=True)
def clear_audio(spark, d):
    df = observations(spark, d)
    return rec.clear_audio(df, rec.audio_to_purge(df, now(), 7)).select("id", "audio_ref")


@query("""SELECT CASE WHEN k % 41 = 0 THEN 'bad' ELSE id END AS id, CASE
  WHEN k % 41 = 0 THEN 'invalid id' WHEN k % 43 = 0 THEN 'invalid status'
  WHEN k % 47 = 0 THEN 'schema_version must be positive'
  WHEN k % 53 = 0 AND quantity IS NOT NULL AND quantity > 0 THEN 'quantity is negative'
  WHEN k % 59 = 0 THEN 'confidence.location out of range' END AS reason FROM (SELECT * REPLACE (CASE k % 41
    WHEN 1 THEN 'urn:uuid:' || id WHEN 2 THEN '{' || id || '}' WHEN 3 THEN replace(id, '-', '') ELSE id END AS id)
    FROM obs)""", obs=True)
def validate(spark, d):
    k = F.col("k")
    df = observations(spark, d).withColumns({
        # every legal spelling of an id, and one that is none
        "id": F.when(k % 41 == 0, "bad").when(k % 41 == 1, F.concat(F.lit("urn:uuid:"), "id"))
        .when(k % 41 == 2, F.concat(F.lit("{"), "id", F.lit("}")))
        .when(k % 41 == 3, F.replace("id", F.lit("-"), F.lit(""))).otherwise(F.col("id")),
        "status": F.when(k % 43 == 0, "lost").otherwise(F.col("status")),
        "schema_version": F.when(k % 47 == 0, 0).otherwise(1),
        "parsed": F.col("parsed").withField("quantity", F.when(
            k % 53 == 0, -F.col("parsed.quantity")).otherwise(F.col("parsed.quantity"))),
        "confidence": F.col("confidence").withField("location", F.when(
            k % 59 == 0, 1.5).otherwise(F.col("confidence.location"))),
    })
    return df.select("id", rec.invalid_reason().alias("reason"))


_TARGET = "CASE k % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'synced' ELSE 'rejected' END"


@query(f"""SELECT m.id, to_status, CASE WHEN o.status IS NULL THEN 'not_found'
  WHEN (o.status = 'draft' AND to_status IN ('confirmed', 'rejected'))
    OR (o.status = 'confirmed' AND to_status IN ('synced', 'rejected')) THEN 'applied'
  ELSE 'bad_transition' END AS outcome
  FROM (SELECT CASE WHEN k % 19 = 0 THEN 'none-' || k ELSE id END AS id, {_TARGET} AS to_status
        FROM obs) m LEFT JOIN obs o USING (id)""", obs=True)
def transitions(spark, d):
    df = observations(spark, d)
    k = F.col("k")
    moves = df.select(
        F.when(k % 19 == 0, F.concat(F.lit("none-"), k.cast("string"))).otherwise(
            F.col("id")).alias("id"),
        F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "synced").otherwise("rejected").alias(
            "to_status"))
    return rec.apply_moves(df, moves).select("id", "to_status", "outcome")


@query("""SELECT id, CASE WHEN k % 4 = 0 AND status = 'confirmed' THEN 'synced' ELSE status END
  AS status, k % 4 = 0 AND status = 'confirmed' AS newly_synced,
  CASE WHEN NOT (k % 4 = 0 AND status = 'confirmed') THEN sync_rejected_reason END
  AS sync_rejected_reason FROM obs""", obs=True)
def mark_synced(spark, d):
    df = observations(spark, d)
    return rec.mark_synced(df, df.where("k % 4 = 0").select("id"), now()).select(
        "id", "status", F.coalesce("newly_synced", F.lit(False)).alias("newly_synced"),
        "sync_rejected_reason")


@query("SELECT id FROM obs WHERE k % 4 = 0 AND status = 'rejected'", obs=True)
def diverged(spark, d):
    df = observations(spark, d)
    return rec.diverged(df, df.where("k % 4 = 0").select("id"))


@query("""SELECT id, CASE WHEN k % 7 = 0 AND status = 'confirmed' THEN 'stale price'
  ELSE sync_rejected_reason END AS sync_rejected_reason, status FROM obs""", obs=True)
def reject_badge(spark, d):
    df = observations(spark, d)
    refusals = df.where("k % 7 = 0").select("id", F.lit("stale price").alias("reason"))
    return rec.reject_badges(df, refusals, now()).select("id", "sync_rejected_reason", "status")


@query("SELECT id FROM obs WHERE k % 5 = 0 AND k % 10 <> 0", obs=True)
def void_leftover(spark, d):
    df = observations(spark, d)
    voids = df.where("k % 5 = 0").select("id")
    return rec.pending_voids(voids, voids.limit(0), df.where("k % 10 = 0").select("id"))


@query("SELECT id FROM obs WHERE (k % 6 = 0 OR status = 'rejected') AND k % 4 <> 0", obs=True)
def void_pending(spark, d):
    df = observations(spark, d)
    return rec.pending_voids(df.where("k % 6 = 0"), df.where("status = 'rejected'"),
                             df.where("k % 4 = 0"))


@query("SELECT id, status FROM obs WHERE status <> 'rejected'", obs=True)
def void_apply(spark, d):
    df = observations(spark, d)
    return rec.apply_voids(df, df.where("status = 'rejected'")).select("id", "status")


@query("""SELECT l_orderkey AS id, min(l_linenumber)::BIGINT AS pos FROM lineitem GROUP BY 1""")
def dedupe_ids(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("pos"))
    return rec.dedupe(li, "id", "pos")


_MERGED_SQL = """SELECT id, device_id, CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN 'synced' ELSE status END AS status,
  CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN 3 ELSE 1 END::BIGINT AS arrival FROM obs
  UNION ALL SELECT id || 'n', 'first', 'draft', 1::BIGINT FROM obs WHERE k % 50 = 0"""


def _merge_case(spark, d):
    cols = ["id", "device_id", "status", "arrival"]
    base = observations(spark, d).withColumn("arrival", F.lit(1).cast("bigint"))

    def sent(rows, device, status, arrival):
        return rows.withColumns({"device_id": device, "status": F.lit(status),
                                 "arrival": F.lit(arrival).cast("bigint")}).select(*cols)

    own = F.when(F.col("k") % 7 == 0, "intruder").otherwise(F.col("device_id"))
    again = base.where("k % 3 = 0")
    new = base.where("k % 50 = 0").withColumn("id", F.concat("id", F.lit("n")))
    # another device may not overwrite a record, however early or late its row arrives;
    # a new record belongs to the device whose row came first
    batch = (sent(again, own, "draft", 2).unionAll(sent(again, own, "synced", 3))
             .unionAll(sent(base.where("k % 4 = 0"), F.lit("intruder"), "rejected", 0))
             .unionAll(sent(new, F.lit("second"), "synced", 2)).unionAll(sent(new, F.lit("first"), "draft", 1)))
    return base.select(*cols), batch


@query(_MERGED_SQL, obs=True)
def merge_upsert(spark, d):
    return rec.upsert(*_merge_case(spark, d), "arrival")


@query(_MERGED_SQL, obs=True)
def merge_bucketed(spark, d):
    """The same merge into a base bucketed by record id: only the batch is shuffled."""
    base, batch = _merge_case(spark, d)
    name = f"records_{uuid.uuid4().hex}"
    stored = sources.write_bucketed(base, name, f"{shared_dir(spark)}/{name}")
    return rec.upsert_bucketed(stored, batch, "arrival")


@query("""SELECT observation_id, field, to_value, row_number() OVER (PARTITION BY observation_id
  ORDER BY log."at", log.pos) AS seq FROM log""", log=True)
def corr_log(spark, d):
    return rec.number_corrections(correction_log(spark, d)).select(
        "observation_id", "field", "to_value", "seq")


@query("""SELECT id, count(l.pos) AS n, coalesce(string_agg(l.field || ':' || l.to_value, '|'
  ORDER BY l.at, l.pos), '') AS corrections FROM obs LEFT JOIN log l ON l.observation_id = id
  GROUP BY id""", log=True)
def corr_attach(spark, d):
    log = rec.number_corrections(correction_log(spark, d))
    return rec.attach_corrections(observations(spark, d), log).select(
        "id", F.size("corrections").cast("bigint").alias("n"),
        F.array_join(F.transform("corrections", lambda c: F.concat(
            c["field"], F.lit(":"), c["to_value"])), "|").alias("corrections"))


@query("""SELECT observation_id, field, to_value FROM (SELECT *, row_number() OVER (
  PARTITION BY observation_id, field ORDER BY log."at" DESC, log.pos DESC) AS rn FROM log) WHERE rn = 1""",
       log=True)
def corr_latest(spark, d):
    return rec.latest_corrections(correction_log(spark, d)).select("observation_id", "field", "to_value")


@query("""SELECT id, strftime(captured_at, '%Y-%m-%dT%H:%M:%SZ') AS captured_at, operator_id,
  device_id, CASE WHEN quantity IS NULL THEN '' WHEN quantity = floor(quantity)
    THEN quantity::BIGINT::VARCHAR ELSE quantity::VARCHAR END AS quantity,
  coalesce(unit, '') AS unit, item_text, coalesce(part_number, '') AS part_number, location_text,
  coalesce(location_id, '') AS location_id, status, needs_review::VARCHAR AS needs_review,
  coalesce(sync_rejected_reason, '') AS sync_rejected_reason, '' AS description, raw_transcript
  FROM obs""", obs=True)
def csv_export(spark, d):
    return rec.csv_rows(observations(spark, d))


@query("""SELECT id, quantity, status, location_text, device_id, round(c_asr, 6) AS asr FROM obs""", obs=True)
def obs_json(spark, d):
    # written as JSON texts, and read back
    j = sources.json_rows(observations(spark, d).drop("k"))
    text = F.col(j.columns[-1])
    got = j.select(F.from_json(text, "id string, device_id string, status string, parsed struct<quantity:double,"
                               "location_text:string>, confidence struct<asr:double>").alias("o")).select("o.*")
    return got.select("id", "parsed.quantity", "status", "parsed.location_text", "device_id",
                      F.round("confidence.asr", 6).alias("asr"))


@query("""SELECT device_id, id FROM obs""", obs=True)
def batch_ingest(spark, d):
    # one batch document per 50 records of a device, written and read as JSON
    df = rec.push_batches(observations(spark, d).withColumn("status", F.lit("confirmed")))
    record = F.struct("id", "device_id", "status", "parsed", "confidence")
    raw = df.groupBy("device_id", "batch_no").agg(F.collect_list(record).alias("observations"))
    texts = raw.select(F.to_json(F.struct("device_id", "observations")).alias("j"))
    from tallyline.schema import BATCH
    docs = texts.select(F.from_json("j", BATCH).alias("b")).select("b.*")
    return sources.explode_batches(docs).select("device_id", "id")


@query("""SELECT CASE k % 2 WHEN 0 THEN 'en' ELSE 'es' END AS language, 'confirmed' AS status,
  id, k % 10 = 0 AS needs_review FROM obs WHERE item_text IS NOT NULL""", obs=True)
def manual_entry(spark, d):
    k = F.col("k")
    typed = observations(spark, d).select(
        "id", "device_id", "k", F.when(k % 2 == 0, "fr").otherwise("es").alias("language"),
        F.col("parsed").withField("location_text", F.lit("A-1")).alias("parsed"),
        F.lit(True).alias("confirm"))
    return ed.manual_entries(typed).select("language", "status", "id", "needs_review")


@query("""SELECT id, CASE WHEN k % 60 = 5 THEN 'protocol' WHEN k % 6 = 1 THEN 'expired'
  WHEN k % 6 = 2 OR k % 60 = 10 THEN 'mismatch' WHEN k % 6 = 3 OR k % 60 = 16 THEN 'digest'
  ELSE 'ok' END AS result FROM obs""", obs=True)
def claims_check(spark, d):
    k = F.col("k")
    payload = F.encode(F.to_json("parsed"), "utf-8")
    df = observations(spark, d).withColumn("payload", payload).withColumns({
        # what is missing fails, but for an expiry
        "protocol": F.when(k % 60 != 5, "observation/v1"),
        "claims": F.struct(
            F.when(k % 60 == 10, None).when(k % 6 == 2, "other").otherwise(F.col("id")).alias("id"),
            F.col("device_id").alias("device_id"), F.col("operator_id").alias("operator_id"),
            F.when(k % 6 == 1, now() - F.make_dt_interval(secs=F.lit(1))).when(
                k % 60 != 22, now()).alias("expires_at"),
            F.when(k % 60 == 16, None).when(k % 6 == 3, "00").otherwise(F.sha2("payload", 256)).alias("sha256")),
    })
    problem = rec.claims_problem(now(), "observation/v1")
    return df.withColumn("p", problem).select("id", F.when(
        F.col("p") == "unexpected protocol", "protocol").when(
        F.col("p") == "token expired", "expired").when(
        F.col("p") == "claims do not match payload", "mismatch").when(
        F.col("p").isNotNull(), "digest").otherwise("ok").alias("result"))


# --- aggregations ----------------------------------------------------------


@query("SELECT status, count(*) AS n FROM obs GROUP BY status", obs=True)
def counts_by_status(spark, d):
    return an.counts_by_status(observations(spark, d))


@query("SELECT device_id, status, count(*) AS n FROM obs GROUP BY ROLLUP (device_id, status)",
       obs=True)
def counts_rollup(spark, d):
    return an.counts_rollup(observations(spark, d))


@query("""SELECT device_id, max(id) AS last_id FROM obs WHERE status IN ('draft', 'confirmed')
  GROUP BY device_id""", obs=True)
def last_active(spark, d):
    return an.last_active(observations(spark, d))


@query("""SELECT location_id, sum(quantity) AS quantity, count(*) AS parts FROM (
  SELECT location_id, part_number, max_by(quantity, id) AS quantity, max(id) AS i FROM (
    SELECT location_id, part_number, id, coalesce(quantity, -1) AS quantity FROM obs
    WHERE status IN ('confirmed', 'synced') AND location_id IS NOT NULL AND part_number IS NOT NULL)
  GROUP BY 1, 2) GROUP BY 1""".replace("sum(quantity)", "sum(nullif(quantity, -1))"), obs=True)
def stock_by_location(spark, d):
    df = observations(spark, d).select("id", "status", "parsed.*")
    return an.stock_by_location(df)


@query("""SELECT reason, count(*) AS n FROM (SELECT 'no location spoken' AS reason FROM obs
  WHERE k % 5 = 0 UNION ALL SELECT 'no quantity spoken' FROM obs WHERE k % 10 = 0) GROUP BY 1""",
       obs=True)
def review_reasons(spark, d):
    return an.review_reason_histogram(observations(spark, d))


@query("""SELECT f.operator_id, f.field, f.corrections, f.records, round(f.records / c.captured, 6)
  AS rate FROM (SELECT operator_id, field, count(*) AS corrections, count(DISTINCT observation_id)
  AS records FROM log JOIN obs ON id = observation_id GROUP BY CUBE (operator_id, field)) f
  JOIN (SELECT operator_id, count(*) AS captured FROM obs GROUP BY CUBE (operator_id)) c
  ON f.operator_id IS NOT DISTINCT FROM c.operator_id""", log=True)
def correction_rate(spark, d):
    out = an.correction_rates(correction_log(spark, d), observations(spark, d), tasks_for(table(spark, d, "lineitem")))
    return out.withColumn("rate", F.round("rate", 6))


@query("""SELECT count(*) AS captured, sum(CASE WHEN k % 12 <> 0
  AND k % 15 <> 0 THEN 1 ELSE 0 END)::BIGINT AS correct,
  round(avg(CASE WHEN k % 12 <> 0 AND k % 15 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM obs WHERE status <> 'rejected'""", obs=True)
def accuracy(spark, d):
    df = observations(spark, d).select("k", "id", "status", "parsed.*")
    k = F.col("k")
    truth = df.select(
        F.col("id").alias("item_key"),
        F.when(k % 12 == 0, -1.0).otherwise(F.col("quantity")).alias("true_quantity"),
        F.when(k % 15 == 0, "elsewhere").otherwise(F.col("location_id")).alias("true_location_id"))
    out = an.accuracy(df.withColumnRenamed("id", "item_key"), truth)
    return out.withColumn("accuracy", F.round("accuracy", 6))


def _captures(spark, d):
    """Capture events with a latency in milliseconds; event ids are time-ordered."""
    return table(spark, d, "events").select(
        F.concat(F.lit("dev-"), (F.col("user_id") % 40).cast("string")).alias("device_id"),
        F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).cast("bigint").alias("latency"))


_CAPTURES = """cap AS (SELECT 'dev-' || (user_id % 40) AS device_id, event_id AS seq,
  floor(value * 100)::BIGINT AS latency FROM events)"""


@query(f"""WITH {_CAPTURES} SELECT device_id, count(*) AS utterances, max_by(latency, seq)
  AS last_latency, list_sort(list(latency))[(count(*) // 2)::INT + 1] AS median_latency
  FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq DESC) AS rn FROM cap)
  WHERE rn <= 50 GROUP BY device_id""")
def latency_stats(spark, d):
    return an.latency_stats(_captures(spark, d), "device_id", "seq", "latency")


@query(f"""WITH {_CAPTURES}, roll AS (SELECT device_id, seq, list_sort(list(latency) OVER (
    PARTITION BY device_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS l FROM cap)
  SELECT device_id, min(seq) AS first_alert FROM roll
  WHERE len(l) >= 3 AND l[len(l) // 2 + 1] > 3000 GROUP BY device_id""")
def latency_alert(spark, d):
    return an.latency_alerts(_captures(spark, d), "device_id", "seq", "latency", F.lit(3000))


@query("""SELECT id, device_id, round(epoch(captured_at) - epoch(lag(captured_at) OVER (
  PARTITION BY device_id ORDER BY id)), 6)::DOUBLE AS gap_seconds FROM obs""", obs=True)
def time_per_item(spark, d):
    return an.time_per_item(observations(spark, d)).select(
        "id", "device_id", F.round("gap_seconds", 6).alias("gap_seconds"))


@query("""SELECT device_id, sum(CASE WHEN status = 'confirmed' AND k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT
  AS pushed, ceil(sum(CASE WHEN status = 'confirmed' THEN 1 ELSE 0 END) / 50)::BIGINT AS batches,
  sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS rejected,
  sum(CASE WHEN k % 44 = 0 THEN 1 ELSE 0 END)::BIGINT AS voided FROM obs GROUP BY device_id""",
       obs=True)
def push_report(spark, d):
    df = observations(spark, d)
    return an.push_report(df, df.where("k % 4 = 0"), df.where("k % 7 = 0"), df.where("k % 44 = 0"))


@query("""SELECT 'locations' AS dimension, (SELECT count(DISTINCT (o_orderkey % 26, o_orderkey % 90))
  FROM orders) AS n UNION ALL SELECT 'parts', (SELECT count(DISTINCT p_name) FROM part)
  UNION ALL SELECT 'units', (SELECT count(DISTINCT p_type) FROM part)""")
def pull_report(spark, d):
    units = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    return an.pull_report(location_dimension(spark, d), part_dimension(spark, d), units).select(
        "dimension", "n")


@query("""SELECT 'parts' AS dimension, count(DISTINCT p_name) AS n, 'not_modified' AS outcome FROM part
  UNION ALL SELECT 'renamed', count(DISTINCT p_name), 'modified' FROM part
  UNION ALL SELECT 'shorter', count(DISTINCT p_name) - 1, 'modified' FROM part""")
def snapshot_digest(spark, d):
    p = part_dimension(spark, d)
    first = F.col("name") == p.agg(F.min("name").alias("m")).first().m
    new = {"parts": p.repartition("name"), "shorter": p.where(~first),
           "renamed": p.withColumn("name", F.when(first, "another").otherwise(F.col("name")))}
    return an.refresh_report(dict.fromkeys(new, p), new)


@query("SELECT part_number, name FROM parts", parts=True)
def refdata_snapshot(spark, d):
    root = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    parts = part_dimension(spark, d)
    outcomes = [sources.refresh_snapshot(x, root) for x in (parts.limit(1), parts, parts.repartition("name"))]
    if outcomes != ["modified", "modified", "not_modified"]:
        raise AssertionError(outcomes)
    return sources.read_snapshot(spark, root).select("part_number", "name")


@query("SELECT part_number AS id, name, name || 's' AS alias FROM parts", parts=True)
def refdata_explode(spark, d):
    from tallyline.schema import REFDATA
    # documents of at most a hundred parts (numbers with equal leading digits), as one JSON text each
    parts = part_dimension(spark, d)
    docs = parts.groupBy(F.expr("left(part_number, length(part_number) - 2)").alias("g")).agg(
        F.collect_list(F.struct("part_number", "name", "aliases")).alias("parts"))
    raw = docs.select(F.to_json(F.struct("parts")).alias("j")).select(
        F.from_json("j", REFDATA).alias("r")).select("r.*")
    got = sources.explode_refdata(raw)["parts"]
    return got.select(F.col("part_number").alias("id"), "name", F.col("aliases")[0].alias("alias"))


@query("""SELECT event_id AS id, 'x' || event_type || ' ' || user_id AS text,
  CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'es' END AS language,
  round((least(value / 50, 1.0) + 1.0) / 2, 6) AS asr_confidence, 2::BIGINT AS tokens FROM events""")
def asr_json(spark, d):
    def token(t, p):
        return F.struct(F.lit(t).alias("text"), p.alias("p"),
                        F.struct(F.lit(0).alias("from"), F.lit(30).alias("to")).alias("offsets"))

    e = table(spark, d, "events")
    segment = F.struct(
        F.concat(F.lit(" x"), "event_type").alias("text"),
        F.array(token("[_BEG_]", F.lit(0.1)), token("a", F.col("value") / 50),
                token("b", F.lit(1.5)), token("<|endoftext|>", F.lit(0.2))).alias("tokens"))
    tail = F.struct(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("text"),
                    F.lit(None).cast("array<struct<text:string,p:double,offsets:struct<from:int,to:int>>>"
                                     ).alias("tokens"))
    doc = F.to_json(F.struct(
        F.struct(F.when(F.col("user_id") % 2 == 0, "en").otherwise("es").alias("language")).alias("result"),
        F.array(segment, tail).alias("transcription")))
    out = sources.read_transcripts(e.select(F.col("event_id").alias("id"), doc.alias("json")))
    return out.select("id", "text", "language", F.round("asr_confidence", 6).alias("asr_confidence"),
                      F.size("tokens").cast("bigint").alias("tokens"))


# --- scalar functions ------------------------------------------------------

_ACC = f"translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}')"


@query(f"SELECT doc_id, {_ACC} AS folded FROM documents")
def fold(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fold("text").alias("folded"))


@query(f"SELECT doc_id, translate({_ACC}, ' -./', '') AS canon FROM documents")
def canon_code(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.canon_code("text").alias("canon"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name || 's boxes gas', ' '),
  lambda w: CASE WHEN w LIKE '%es' AND strlen(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND strlen(w) > 3
  THEN w[:-2] ELSE w END), ' ') AS singular FROM part""")
def depluralize(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.depluralize(
        F.concat("p_name", F.lit("s boxes gas"))).alias("singular"))


@query("""SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance,
  round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity
  FROM part""")
def levenshtein(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", sim.levenshtein("p_name", "p_type").cast("bigint").alias("distance"),
        F.round(sim.similarity("p_name", "p_type"), 6).alias("similarity"))


@query("""SELECT p_partkey, round(jaro_similarity(lower(p_brand), 'brand#21'), 6) AS jaro FROM part""")
def jaro(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(sim.jaro(
        F.lower("p_brand"), F.lit("brand#21")), 6).alias("jaro"))


@query("""SELECT p_partkey, regexp_matches(lower(p_brand[7:] || chr((97 + p_size % 26)::INT)), '^[a-z0-9-]{1,10}$')
  AS code, upper(chr((97 + p_size % 26)::INT)) || '-' || p_size AS shown FROM part""")
def code_tokens(spark, d):
    letter = F.chr(97 + F.col("p_size") % 26)
    return table(spark, d, "part").select(
        "p_partkey", tx.is_code(F.lower(F.concat(F.substr("p_brand", F.lit(7)), letter))).alias("code"),
        tx.code_display(F.concat(letter, F.col("p_size").cast("string"))).alias("shown"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS plain, floor(o_totalprice) AS grouped,
  NULL::DOUBLE AS broken FROM orders""")
def digits(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast(
        "decimal(18,2)").cast("string").alias("s"), F.floor("o_totalprice").alias("f"))
    return o.select(
        "o_orderkey", tx.parse_digits("s").alias("plain"),
        tx.parse_digits(F.format_number("f", 0)).alias("grouped"),
        tx.parse_digits(F.concat("s", F.lit(".1"))).alias("broken"))


@query("""SELECT id, CASE WHEN quantity IS NULL THEN '' WHEN quantity = floor(quantity)
  THEN quantity::BIGINT::VARCHAR ELSE quantity::VARCHAR END AS shown,
  (k % 9 + 1) || repeat('0', 16 + (k % 290)::INT) AS large, '0.' || repeat('0', (k % 300)::INT) || (k % 9 + 1) AS small,
  (1000000000000000 + k % 1000) || '.5' AS half FROM obs""", obs=True)
def format_quantity(spark, d):
    k = F.col("k")
    digit = (k % 9 + 1).cast("string")
    large = F.concat(digit, F.lit("e"), (k % 290 + 16).cast("string"))
    small = F.concat(digit, F.lit("e-"), (k % 300 + 1).cast("string"))
    half = (1000000000000000 + k % 1000).cast("double") + 0.5
    return observations(spark, d).select(
        "id", tx.format_quantity("parsed.quantity").alias("shown"),
        tx.format_quantity(large.cast("double")).alias("large"),
        tx.format_quantity(small.cast("double")).alias("small"), tx.format_quantity(half).alias("half"))


@query("""SELECT id, CASE WHEN quantity IS NULL THEN CASE language WHEN 'es' THEN 'sin cantidad'
    ELSE 'no quantity' END ELSE concat_ws(' ', CASE WHEN quantity = floor(quantity)
    THEN quantity::BIGINT::VARCHAR ELSE quantity::VARCHAR END, unit) END || ', ' || item_text
    || ', ' || CASE WHEN location_text <> '' THEN location_text WHEN language = 'es'
    THEN 'sin ubicación' ELSE 'no location' END || CASE language WHEN 'es' THEN '. ¿Correcto?'
    ELSE '. Correct?' END AS line FROM obs""", obs=True)
def readback(spark, d):
    p = "parsed."
    return observations(spark, d).select("id", tx.readback(
        p + "quantity", p + "unit", p + "item_text", p + "location_text", "language").alias("line"))


@query("""SELECT p_partkey, (length(p_name) - length(replace(p_name, ' ', '')) + 4)::BIGINT AS tokens,
  2::BIGINT AS clauses FROM part""")
def tokenize(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("(forty-two) "), "p_name", F.lit(", - \"x.\"")).alias("text"))
    t = tokenize_text(p)
    return t.select("p_partkey", F.size("tokens").cast("bigint").alias("tokens"), (
        F.element_at("tokens", -1)["clause"] + 1).cast("bigint").alias("clauses"))


@query()
def document_tokens(spark, d):
    t = tokenize_text(table(spark, d, "documents"))
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("tokens"), F.coalesce(
        F.element_at("tokens", -1)["clause"] + 1, F.lit(0)).cast("bigint").alias("clauses"))


# --- extraction ------------------------------------------------------------


@query("SELECT o_orderkey AS k, (o_orderkey % 999999 + 1)::DOUBLE AS value, FALSE AS approx FROM orders")
def num_words(spark, d):
    from tallyline.plans.corpus import spoken
    k = F.col("o_orderkey")
    said = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(
        k.alias("k"), spoken(k % 999999 + 1).alias("text"), F.lit("en").alias("lang"))
    n = ex.scan_numbers(said)
    return n.select("k", F.col("numbers")[0]["value"].alias("value"),
                    (F.col("numbers")[0]["approx"] | (F.size("numbers") != 1)).alias("approx"))


@query("""SELECT utt_id, CASE variant WHEN 3 THEN num::DOUBLE WHEN 5 THEN q + 1 WHEN 6 THEN NULL
  ELSE q END AS first_number, variant IN (2, 6) AS approx FROM said""", utt=True)
def num_scan(spark, d):
    first = F.col("numbers")[0]
    return ex.scan_numbers(utterances(spark, d)).select(
        "utt_id", first["value"].alias("first_number"), first["approx"].alias("approx"))


@query("""SELECT p_partkey, n AS pos, CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 ELSE 2 END AS clause
  FROM part, range(5) r(n)""")
def clauses(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("one two, "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" x; "),
        "p_type").alias("text"))
    t = tokenize_text(p).select("p_partkey", F.explode("tokens").alias("t"))
    return t.select("p_partkey", F.col("t.pos").cast("bigint").alias("pos"), "t.clause")


@query("""SELECT p_partkey, 0::BIGINT AS pos, 3::BIGINT AS n_tokens, 'approx' AS class FROM part
  UNION ALL SELECT p_partkey, 3, 1, 'ones' FROM part UNION ALL SELECT p_partkey, 4, 1, 'unit' FROM part
  UNION ALL SELECT p_partkey, 5, 1, 'of' FROM part""")
def phrase_match(spark, d):
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select(
        "p_partkey", F.lit("en").alias("lang"), F.concat(
            F.lit("more or less twelve boxes of "), "p_name").alias("text"))
    hits = lexicon.match_phrases(
        tokenize_text(p), lexicon.lexicon_frame(spark), "p_partkey")
    return hits.select("p_partkey", F.col("pos").cast("bigint").alias("pos"),
                       F.col("n_tokens").cast("bigint").alias("n_tokens"), "class")


@query("SELECT utt_id, location FROM said", utt=True)
def loc_extract(spark, d):
    return ex.per_text(utterances(spark, d), ex.extract).select(
        "utt_id", F.col("parse.location_text").alias("location"))


@query("SELECT utt_id, quantity, unit, approx, vague FROM said", utt=True)
def qty_unit(spark, d):
    return ex.per_text(utterances(spark, d), ex.extract).select(
        "utt_id", "parse.quantity", "parse.unit", F.col("parse.quantity_approx").alias("approx"),
        F.col("parse.quantity_vague").alias("vague"))


@query("""SELECT utt_id, name AS item, location, quantity, CASE variant WHEN 4 THEN 'location'
  WHEN 5 THEN 'quantity' ELSE '' END AS overridden FROM said""", utt=True)
def corrections_inline(spark, d):
    return ex.per_text(utterances(spark, d), ex.extract).select(
        "utt_id", F.col("parse.item_text").alias("item"),
        F.col("parse.location_text").alias("location"), "parse.quantity",
        F.array_join("parse.overridden", ",").alias("overridden"))


@query("""SELECT p_partkey, 1.0::DOUBLE AS quantity, 'box' AS unit, p_name AS item,
  'shelf ' || p_size AS location, 'near ' || p_type AS description, 0.85::DOUBLE AS certainty FROM part""")
def article_qty(spark, d):
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type"), "p_partkey").select(
        "p_partkey", F.concat(
        F.lit("a box of "), "p_name", F.lit(" on shelf "), F.col("p_size").cast("string"),
        F.lit(" near "), "p_type").alias("text"), F.lit("en").alias("lang"))
    return ex.per_text(p, ex.extract).select(
        "p_partkey", "parse.quantity", "parse.unit", F.col("parse.item_text").alias("item"),
        F.col("parse.location_text").alias("location"), "parse.description",
        F.col("parse.cert_quantity").alias("certainty"))


@query("""SELECT o_orderkey, 'item' || (o_orderkey % 50) || 'x ' || p_name AS item,
  'damaged ' || p_type || ', seen twice' AS description FROM orders
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""")
def item_desc(spark, d):
    j = dealt(orders_with_parts(spark, d), "o_orderkey")
    item = F.concat(F.lit("item"), (F.col("o_orderkey") % 50).cast("string"), F.lit("x "), "p_name")
    text = F.concat(F.lit("damaged "), "p_type", F.lit("; 12 boxes of "), item,
                    F.lit(" in bin B-2 and seen twice"))
    u = ex.per_text(j.select("o_orderkey", text.alias("text"), F.lit("en").alias("lang")), ex.extract)
    return u.select("o_orderkey", F.col("parse.item_text").alias("item"), "parse.description")


@query("""SELECT o_orderkey, n AS item_no, CASE n WHEN 0 THEN (o_orderkey % 80 + 1)::DOUBLE
  WHEN 1 THEN 3.0 ELSE 1.0 END AS quantity, CASE n WHEN 0 THEN p_name WHEN 1 THEN 'cat6 wire'
  ELSE 'tape' END AS item, 'C-' || (o_orderkey % 70) AS location
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part), range(3) r(n)""")
def multi_item(spark, d):
    j = dealt(orders_with_parts(spark, d), "o_orderkey")
    k = F.col("o_orderkey")
    text = F.concat((k % 80 + 1).cast("string"), F.lit(" boxes of "), "p_name", F.lit(" in bin c"),
                    (k % 70).cast("string"), F.lit(" and three reels of cat6 wire plus a roll of tape"))
    u = ex.per_text(j.select("o_orderkey", text.alias("text"), F.lit("en").alias("lang")),
                    lambda t, said, lang: ex.extract_items(t, [said, lang], said, lang))
    return u.select("o_orderkey", F.col("item_no").cast("bigint").alias("item_no"), "parse.quantity",
                    F.col("parse.item_text").alias("item"), F.col("parse.location_text").alias("location"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'set_field' WHEN 1 THEN 'set_field'
  WHEN 2 THEN 'set_field' WHEN 3 THEN 'confirm' WHEN 4 THEN 'scratch' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN 'location' WHEN 1 THEN 'quantity' WHEN 2 THEN 'location' END AS field,
  CASE o_orderkey % 6 WHEN 0 THEN 'A-' || (o_orderkey % 60) WHEN 1 THEN (o_orderkey % 90)::VARCHAR
    WHEN 2 THEN 'B-' || (o_orderkey % 60) END AS value FROM orders""")
def commands(spark, d):
    k = F.col("o_orderkey")
    v = k % 6
    text = (
        F.when(v == 0, F.concat(F.lit("The location is A-"), (k % 60).cast("string")))
        .when(v == 1, F.concat(F.lit("cambia la cantidad a "), (k % 90).cast("string")))
        .when(v == 2, F.concat(F.lit("No, bin b "), (k % 60).cast("string")))
        .when(v == 3, "yes, correct").when(v == 4, "Scratch that.")
        .otherwise(F.concat(F.lit("no boxes left, row "), k.cast("string")))
    )
    o = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", text.alias("text"), F.when(v == 1, "es").otherwise("en").alias("lang"))
    return ex.commands(o).select("o_orderkey", "command.kind", "command.field", "command.value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'aisle ' || (o_orderkey % 90) || ' / shelf 2'
  ELSE 'the back corner ' || o_orderkey END AS location_text, (o_orderkey % 900 + 1)::DOUBLE AS quantity,
  TRUE AS approx FROM orders""")
def edit_values(spark, d):
    from tallyline.plans.corpus import spoken
    k = F.col("o_orderkey")
    o = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", F.lit("en").alias("lang"),
        F.when(k % 2 == 0, F.concat(F.lit("aisle "), (k % 90).cast("string"), F.lit(" shelf two")))
        .otherwise(F.concat(F.lit(" the back corner "), k.cast("string"))).alias("value"),
        F.concat(F.lit("about "), spoken(k % 900 + 1)).alias("qv"))
    out = ex.per_text(ex.per_text(o, ex.location_value, "value"), ex.quantity_value, "qv")
    return out.select("o_orderkey", "location_text", "quantity",
                      F.col("quantity_approx").alias("approx"))


@query("""SELECT doc_id FROM documents""")
def document_extract(spark, d):
    """Invariants on free text: quantities are not negative, certainties within [0, 1]."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    p = ex.extract(docs).select("doc_id", "parse.*")
    return p.where("(quantity IS NULL OR quantity >= 0) AND cert_quantity BETWEEN 0 AND 1").select("doc_id")


def _letters(n):
    """A number in letters, so that no token scanner takes it for a code."""
    return F.translate(n.cast("string"), "0123456789", "bcdfghklmn")


_BACKEND_SQL = """u AS (
  SELECT o_orderkey AS k, o_orderkey % 7 = 6 AS es, p_partkey % 3 AS spoken_in, o_orderkey % 40 + 2 AS n,
    translate(p_partkey::VARCHAR, '0123456789', 'bcdfghklmn') AS letters, o_orderkey % 2 = 0 AS by_name
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
w AS (SELECT *, CASE WHEN by_name THEN 'zu' ELSE 'za' END || letters AS word,
    spoken_in = 0 OR (spoken_in = 1) = NOT es AS known FROM u)"""


@query("WITH " + _BACKEND_SQL + """
SELECT k, n::DOUBLE AS quantity, CASE WHEN known THEN word END AS unit,
  CASE WHEN known THEN 'zu' || letters END AS canonical_unit,
  CASE WHEN known THEN 'connectors' ELSE word || ' connectors' END AS item FROM w""")
def backend_units(spark, d):
    """Every part names a unit with an alias, in one language or both; every order says one."""
    j = dealt(orders_with_parts(spark, d), "o_orderkey")
    k, letters = F.col("o_orderkey"), _letters(F.col("p_partkey"))
    word = F.concat(F.when(k % 2 == 0, "zu").otherwise("za"), letters)
    said = j.select(k.alias("k"), F.when(k % 7 == 6, "es").otherwise("en").alias("lang"),
                    F.concat((k % 40 + 2).cast("string"), F.lit(" "), word, F.lit(" connectors")).alias("text"))
    p = table(spark, d, "part")
    own = _letters(F.col("p_partkey"))
    units = p.select(
        F.concat(F.lit(" Z\u00da"), own).alias("name"), F.array(F.concat(F.lit("ZA"), own), F.lit(" ")).alias("aliases"),
        F.when(F.col("p_partkey") % 3 == 1, "en").when(F.col("p_partkey") % 3 == 2, "es").otherwise("").alias("language"))
    out = ex.per_text(said, lambda t, words, lang: voc.extract_with_units(
        t.withColumn("said", F.concat(lang, words)), units, "said", words, lang).drop("said"))
    return out.select("k", F.col("parse.quantity").alias("quantity"), F.col("parse.unit").alias("unit"),
                      "canonical_unit", F.col("parse.item_text").alias("item"))


@query("""SELECT l.word, count(*) AS n, CASE WHEN l.word IN ('boxes', 'box') THEN 'box'
  WHEN l.word = 'skids' THEN 'skid' END AS canonical_unit FROM (
  SELECT unnest(['boxes', 'skids', p_name]) AS word FROM part) l GROUP BY l.word""")
def unit_lookup(spark, d):
    from tallyline.schema import UNIT
    words = table(spark, d, "part").select(
        F.explode(F.array(F.lit("boxes"), F.lit("skids"), F.col("p_name"))).alias("word"),
        F.lit("en").alias("lang"))
    units = table(spark, d, "part").select(
        F.lit("skid").alias("name"), F.lit("en").alias("language"),
        F.array(F.lit("skids")).alias("aliases")).distinct()
    return lexicon.unit_lookup(words, units).groupBy("word", "canonical_unit").agg(
        F.count("*").alias("n")).select("word", "n", "canonical_unit")


# --- resolution ------------------------------------------------------------


@query("SELECT p_partkey, part_number FROM part JOIN parts ON p_name = name", parts=True)
def resolve_exact(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("t"))
    return resolve(p, "t", part_dimension(spark, d), "part_number", "id", "score", False).select(
        "p_partkey", F.col("id").alias("part_number"))


@query("""SELECT o_orderkey, 'LOC-' || chr((65 + o_orderkey % 26)::INT) || '-' || (o_orderkey % 90 + 1)
  AS location_id, 0.98::DOUBLE AS score FROM orders""")
def resolve_code(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(
        F.chr(97 + k % 26), F.lit(" . "), (k % 90 + 1).cast("string")).alias("t"))
    return resolve(o, "t", location_dimension(spark, d), "id", "location_id", "score", True).select(
        "o_orderkey", "location_id", "score")


def _singular_sql(c):
    return f"""array_to_string(list_transform(list_filter(regexp_split_to_array({c}, ' +'), lambda w: w <> ''),
      lambda w: CASE WHEN w LIKE '%es' AND strlen(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND strlen(w) > 3 THEN w[:-2] ELSE w END), ' ')"""


#: every text against every key, one character of the text a step; ``rest`` marks taken characters of the key
_FUZZY_SQL = f"""WITH RECURSIVE {PARTS_SQL},
  said AS (SELECT p_partkey, left(p_name, (p_partkey % length(p_name))::INT)
    || substr(p_name, (p_partkey % length(p_name))::INT + 2) AS t FROM part),
  keys AS (SELECT DISTINCT part_number AS id, lower(trim(x)) AS kfold FROM
    (SELECT part_number, unnest([name, part_number, name || 's']) AS x FROM parts)),
  texts AS (SELECT DISTINCT lower(trim(t)) AS fold FROM said),
  exact AS (SELECT fold, min(id) AS id FROM texts JOIN keys ON fold = kfold GROUP BY fold),
  forms AS (SELECT fold, id, unnest([fold, {_singular_sql('fold')}]) AS q, unnest([kfold, {_singular_sql('kfold')}]) AS k
    FROM texts, keys WHERE fold NOT IN (SELECT fold FROM exact)),
  r(q, k, i, rest, hit) AS (
    SELECT DISTINCT q, k, 0, k, '' FROM forms WHERE q <> '' AND k <> '' UNION ALL
    SELECT q, k, i + 1, CASE WHEN found > 0 THEN left(rest, low + found - 1) || chr(1) || substr(rest, low + found + 1) ELSE rest END,
      CASE WHEN found > 0 THEN hit || q[i + 1] ELSE hit END
    FROM (SELECT *, instr(substr(rest, low + 1, greatest(i + reach + 1 - low, 0)), q[i + 1]) AS found
      FROM (SELECT *, greatest(i - reach, 0) AS low
        FROM (SELECT *, greatest(greatest(length(q), length(k)) // 2 - 1, 0) AS reach FROM r WHERE i < length(q))))),
  m AS (SELECT q, k, length(hit)::DOUBLE AS m, hit,
      array_to_string(list_transform(list_filter(range(1, length(k) + 1), lambda n: rest[n] = chr(1)), lambda n: k[n]), '') AS other,
      (SELECT count(*) FROM range(1, 5) AS n(n) WHERE n <= least(length(q), length(k)) AND left(q, n) = left(k, n))::DOUBLE AS p
    FROM r WHERE i = length(q) AND hit <> ''),
  j AS (SELECT q, k, p, (m / length(q) + m / length(k)
    + (m - len(list_filter(range(1, length(hit) + 1), lambda n: hit[n] <> other[n])) / 2::DOUBLE) / m) / 3 AS j FROM m),
  w AS (SELECT q, k, j + p * 0.1::DOUBLE * (1 - j) AS score FROM j),
  best AS (SELECT fold, id, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, id) AS rn
    FROM forms JOIN w USING (q, k) WHERE score >= 0.85::DOUBLE - 1e-12) WHERE rn = 1
    UNION ALL SELECT fold, id, 1.0::DOUBLE FROM exact)
  SELECT p_partkey, t, id, round(score, 6) AS score FROM said LEFT JOIN best ON fold = lower(trim(t))"""


@query(_FUZZY_SQL)
def resolve_fuzzy(spark, d):
    """Misspelt part names against the vocabulary: best id and score."""
    n = F.length("p_name")
    cut = (F.col("p_partkey") % n).cast("int")
    p = table(spark, d, "part").select("p_partkey", F.concat(
        F.substr("p_name", F.lit(1), cut), F.substr("p_name", cut + 2)).alias("t"))
    return resolve(p, "t", part_dimension(spark, d), "part_number", "id", "score", False).select(
        "p_partkey", "t", "id", F.round("score", 6).alias("score"))


@query("""SELECT utt_id, name AS item, part_number, quantity, location FROM said
  JOIN parts USING (name)""", utt=True, parts=True)
def utterance_pipeline(spark, d):
    """Utterance to resolved record: extraction once, then both resolutions."""
    places, parts = location_dimension(spark, d), part_dimension(spark, d)
    out = ex.per_text(utterances(spark, d), lambda t, said, lang: resolve_parse(
        cut_lineage(ex.extract(t, said, lang)), places, parts))
    return out.select("utt_id", F.col("parse.item_text").alias("item"), "parse.part_number",
                      "parse.quantity", F.col("parse.location_text").alias("location"))


# --- confidence, review, edits ----------------------------------------------


@query("""SELECT utt_id, CASE WHEN vague THEN 0.35 WHEN quantity IS NULL THEN 0.0 WHEN approx THEN 0.5
    ELSE 1.0 END::DOUBLE AS cert_quantity, 0.75::DOUBLE AS cert_location, 0.8::DOUBLE AS cert_item
  FROM said""", utt=True)
def certainty(spark, d):
    out = resolve_parse(ex.per_text(utterances(spark, d), ex.extract), None, None)
    return out.select("utt_id", "parse.cert_quantity", "parse.cert_location", "parse.cert_item")


@query("""SELECT utt_id, round(asr, 6) AS asr, round(asr * 0.75, 6) AS location,
  round(asr * 0.8, 6) AS item FROM said""", utt=True)
def confidence(spark, d):
    out = resolve_parse(ex.per_text(utterances(spark, d), ex.extract), None, None)
    out = rv.review_records(out, None, False, False)
    return out.select("utt_id", *[F.round(f"confidence.{n}", 6).alias(n) for n in ("asr", "location", "item")])


@query("""SELECT utt_id, concat_ws('|', CASE WHEN vague THEN 'vague quantity' WHEN quantity IS NULL
    THEN 'no quantity spoken' END, CASE WHEN asr > 0 AND asr < 0.7 THEN 'low speech confidence' END,
  CASE WHEN quantity IS NOT NULL AND asr * CASE WHEN approx THEN 0.5 ELSE 1.0 END < 0.7
    THEN 'low quantity confidence' END,
  CASE WHEN asr * 0.75 < 0.7 THEN 'low location confidence' END,
  CASE WHEN asr * 0.8 < 0.6 THEN 'low item confidence' END,
  CASE WHEN utt_id % 97 = 0 THEN 'utterance hit the 30-second cap; tail may be missing' END) AS reasons
  FROM said""", utt=True)
def review(spark, d):
    out = resolve_parse(ex.per_text(utterances(spark, d), ex.extract), None, None)
    return rv.review_records(out, None, False, False).select(
        "utt_id", F.array_join("review_reasons", "|").alias("reasons"))


_EDIT_REASONS = """concat_ws('|', CASE WHEN quantity IS NULL THEN 'no quantity spoken' END,
  CASE WHEN location_text = '' THEN 'no location spoken' END,
  CASE WHEN c_asr > 0 AND c_asr < 0.7 THEN 'low speech confidence' END,
  CASE WHEN quantity IS NOT NULL AND c_quantity < 0.7 THEN 'low quantity confidence' END,
  CASE WHEN location_text <> '' AND c_location < 0.7 THEN 'low location confidence' END,
  CASE WHEN c_item < 0.6 THEN 'low item confidence' END)"""


@query(f"SELECT id, {_EDIT_REASONS} AS reasons FROM obs", obs=True)
def review_edit(spark, d):
    df = rv.with_profile(observations(spark, d))
    return df.select("id", F.array_join(rv.edit_reasons(
        F.col("parsed"), F.col("confidence")), "|").alias("reasons"))


@query("""SELECT id, concat_ws('|', CASE WHEN quantity IS NULL OR c_quantity < 0.7 THEN 'quantity' END,
  CASE WHEN location_text = '' OR c_location < 0.7 THEN 'location' END,
  CASE WHEN c_item < 0.6 THEN 'item' END) AS fields FROM obs""", obs=True)
def doubtful(spark, d):
    df = rv.with_profile(observations(spark, d))
    return df.select("id", F.array_join(rv.doubtful(
        F.col("parsed"), F.col("confidence")), "|").alias("fields"))


def _profiles(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("dev-"), k.cast("string")).alias("device_id"),
        F.when(k % 4 == 3, "fr").when(k % 2 == 0, "en").otherwise("auto").alias("language"),
        F.when(k % 9 == 8, "vox").otherwise("ptt").alias("capture_mode"),
        F.lit(0.5).alias("asr_threshold"),
        F.when(k % 25 == 24, 1.5).otherwise(0.6).alias("quantity_threshold"),
        F.lit(0.7).alias("location_threshold"), F.lit(0.6).alias("item_threshold"),
        (k % 2 == 0).alias("auto_confirm"),
        F.when(k % 30 == 29, F.array(F.lit("item"), F.lit("colour"))).otherwise(
            F.array(F.lit("item"))).alias("required_fields"),
        (k % 14 - 1).cast("int").alias("keep_days"),
        F.lit(3000).alias("target_latency_ms"), F.lit(50).alias("batch_size"),
        F.lit(False).alias("multi_item"), F.lit(100).alias("high_pass_hz"))


@query("""SELECT 'dev-' || c_custkey AS device_id, CASE WHEN c_custkey % 4 = 3 THEN 'unsupported language'
  WHEN c_custkey % 9 = 8 THEN 'unsupported capture mode' WHEN c_custkey % 14 = 0 THEN 'keep_days is negative'
  WHEN c_custkey % 25 = 24 THEN 'threshold out of range' WHEN c_custkey % 30 = 29
  THEN 'unknown required field' END AS problem FROM customer""")
def profile_check(spark, d):
    return _profiles(spark, d).select("device_id", rv.profile_problem().alias("problem"))


@query("""SELECT k AS id, i AS item_no, CASE WHEN i < k % 3 THEN 'confirmed'
  WHEN dev % 2 = 0 AND k % 5 <> 0 THEN 'confirmed' ELSE 'draft' END AS status
  FROM (SELECT o_orderkey AS k, o_custkey % 20 AS dev FROM orders), range(3) r(i) WHERE i <= k % 3""")
def auto_confirm(spark, d):
    o = observations(spark, d)
    items = o.select("k", "device_id", "needs_review", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("k") % 3)).alias("item_no"))
    return rv.with_profile(items, _profiles(spark, d)).select(
        F.col("k").alias("id"), "item_no", rv.capture_status(
            F.col("needs_review"), F.col("item_no"), F.col("k") % 3 + 1).alias("status"))


@query("""SELECT id, CASE k % 5 WHEN 0 THEN 'location' WHEN 1 THEN 'quantity' WHEN 2 THEN 'unit'
    WHEN 3 THEN 'item' ELSE 'description' END AS field,
  CASE WHEN status IN ('draft', 'confirmed') THEN 'applied' ELSE 'immutable' END AS outcome,
  CASE WHEN status IN ('draft', 'confirmed') THEN CASE k % 5 WHEN 0 THEN 'A-14'
    WHEN 1 THEN '15' WHEN 2 THEN 'reels' WHEN 3 THEN 'gadget ' || (k % 30) ELSE 'dusty' END END AS to_value
  FROM obs""", obs=True)
def apply_edits(spark, d):
    k = F.col("k")
    df = observations(spark, d)
    edits = df.select(
        "id", F.element_at(F.array(*map(F.lit, (
            "location", "quantity", "unit", "item", "description"))), (k % 5 + 1).cast("int")).alias("field"),
        F.when(k % 5 == 0, "bin a 14").when(
            k % 5 == 1, F.when(F.col("language") == "es", "quince").otherwise("fifteen"))
        .when(k % 5 == 2, " Reels ")
        .when(k % 5 == 3, F.concat(F.lit("gadget "), (k % 30).cast("string"))).otherwise("dusty").alias("value"),
        F.col("captured_at").alias("at"))
    out = ed.apply_edits(df, edits, location_dimension(spark, d), part_dimension(spark, d))
    return out.select("id", "field", "outcome", F.col("correction.to").alias("to_value"))


@query("""SELECT id,
    CASE WHEN m THEN concat_ws(',', 'applied', CASE WHEN d THEN 'applied' END, 'applied', CASE WHEN k % 4 = 0 THEN 'applied' END,
      CASE WHEN k % 5 = 0 THEN 'not_understood' END)
    ELSE concat_ws(',', 'immutable', CASE WHEN d THEN 'immutable' END, 'immutable', CASE WHEN k % 4 = 0 THEN 'immutable' END,
      CASE WHEN k % 5 = 0 THEN 'not_understood' END) END AS outcomes,
    CASE WHEN m THEN concat_ws(';', 'item:' || item_text || '>qq ' || (k % 30),
      CASE WHEN d THEN 'item:qq ' || (k % 30) || '>widgets' END,
      CASE WHEN d AND quantity IS DISTINCT FROM 12 THEN 'quantity:' || q || '>12' END,
      CASE WHEN d AND location_text <> 'A-14' THEN 'location:' || location_text || '>A-14' END,
      'quantity:' || CASE WHEN d THEN '12' ELSE q END || '>15', CASE WHEN k % 4 = 0 THEN 'quantity:15>20' END)
    ELSE '' END AS log,
    CASE WHEN NOT m THEN item_text WHEN d THEN 'widgets' ELSE 'qq ' || (k % 30) END AS item,
    CASE WHEN NOT m THEN quantity WHEN k % 4 = 0 THEN 20 ELSE 15 END AS quantity,
    CASE WHEN m AND d THEN 'A-14' ELSE location_text END AS location,
    CASE WHEN m THEN 0.95 ELSE c_quantity END AS c_quantity, CASE WHEN m AND d THEN 0.9 ELSE c_asr END AS c_asr,
    CASE WHEN NOT m THEN concat_ws(',', CASE WHEN k % 5 = 0 THEN 'no location spoken' END, CASE WHEN k % 10 = 0 THEN 'no quantity spoken' END)
      WHEN d THEN '' ELSE concat_ws(',', CASE WHEN location_text = '' THEN 'no location spoken' END,
        CASE WHEN c_asr > 0 AND c_asr < 0.7 THEN 'low speech confidence' END,
        CASE WHEN location_text <> '' AND c_location < 0.7 THEN 'low location confidence' END) END AS reasons
  FROM (SELECT *, status IN ('draft', 'confirmed') AS m, k % 3 = 0 AND k % 8 <> 7 AS d,
      CASE WHEN quantity IS NULL THEN '' WHEN quantity = floor(quantity) THEN quantity::BIGINT::VARCHAR
        ELSE quantity::VARCHAR END AS q FROM obs)
  UNION ALL SELECT 'gone-' || k, 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM obs WHERE k % 50 = 0""", obs=True)
def edit_log(spark, d):
    """Two to five edits of every record, a new dictation among them, folded in the order they were made."""
    k = F.col("k")
    df = observations(spark, d)

    def edit(pos, field, value, where="true", key="id"):
        return df.where(where).select(
            F.expr(key).alias("id"), F.lit(field).alias("field"), value.alias("value"), F.col("captured_at").alias("at"),
            F.lit(pos).alias("pos"), F.lit(0.9).alias("asr_confidence"))

    number = F.when(F.col("language") == "es", "quince").otherwise("fifteen")
    edits = edit(3, "quantity", number)  # the log comes in any order
    for more in (edit(1, "item", F.concat(F.lit(" qq "), (k % 30).cast("string"))),
                 edit(2, "dictation", F.lit("twelve boxes of widgets in bin A-14"), "k % 3 = 0 AND k % 8 <> 7"),
                 edit(4, "quantity", F.lit("20"), "k % 4 = 0"), edit(5, "location", F.lit("  "), "k % 5 = 0"),
                 edit(1, "unit", F.lit("reels"), "k % 50 = 0", "concat('gone-', k)")):
        edits = edits.unionAll(more)
    out = ed.apply_edit_log(df, edits, location_dimension(spark, d), part_dimension(spark, d))
    said = F.transform("corrections", lambda x: F.concat(x["field"], F.lit(":"), x["from"], F.lit(">"), x["to"]))
    return out.select(
        "id", F.array_join("outcomes", ",").alias("outcomes"), F.array_join(said, ";").alias("log"),
        F.col("parsed.item_text").alias("item"), F.col("parsed.quantity").alias("quantity"),
        F.col("parsed.location_text").alias("location"), F.col("confidence.quantity").alias("c_quantity"),
        F.col("confidence.asr").alias("c_asr"), F.array_join("review_reasons", ",").alias("reasons"))


@query("""SELECT id, 'item' AS field, item_text AS from_value, 'new ' || k AS to_value FROM obs
  UNION ALL SELECT id, 'quantity', CASE WHEN quantity IS NULL THEN '' WHEN quantity = floor(quantity)
    THEN quantity::BIGINT::VARCHAR ELSE quantity::VARCHAR END, '7' FROM obs
    WHERE quantity IS DISTINCT FROM 7
  UNION ALL SELECT id, 'location', location_text, 'A-1' FROM obs WHERE location_text <> 'A-1'""", obs=True)
def redictate_diff(spark, d):
    df = observations(spark, d)
    old = df.select("id", "parsed.item_text", "parsed.quantity", "parsed.location_text")
    new = df.select("id", F.concat(F.lit("new "), F.col("k").cast("string")).alias("item_text"),
                    F.lit(7.0).alias("quantity"), F.lit("A-1").alias("location_text"),
                    F.col("captured_at").alias("at"))
    return ed.redictation_log(old, new).select("id", "field", "from_value", "to_value")


# --- text forms ----------------------------------------------------------------


@query("""SELECT k, CASE WHEN k % 3 = 1 THEN 'en' WHEN k % 3 = 2 THEN 'es' WHEN k % 5 = 1 THEN 'en' WHEN k % 5 = 2 THEN 'es'
  ELSE 'en' END AS spoken FROM obs""", obs=True)
def spoken_language(spark, d):
    k = F.col("k")
    return observations(spark, d).select("k", lexicon.effective_language(
        F.when(k % 3 == 1, "en").when(k % 3 == 2, "es").otherwise("auto"),
        F.when(k % 5 == 1, "en").when(k % 5 == 2, "es").when(k % 5 == 3, "fr")).alias("spoken"))


@query("""SELECT k, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS written, epoch_us(t) AS us
  FROM (SELECT k, captured_at + to_microseconds(k * 7919 % 1000000) AS t FROM obs)""", obs=True)
def time_texts(spark, d):
    """Times as fixed-width text and back; digits past the microsecond are cut."""
    at = F.timestamp_micros(F.unix_micros("captured_at") + F.col("k") * 7919 % 1000000)
    df = observations(spark, d).select("k", tx.rfc3339_nanos(at).alias("written"))
    finer = F.replace("written", F.lit("000Z"), F.lit("789Z"))
    return df.select("k", "written", F.unix_micros(tx.parse_rfc3339(finer)).alias("us"))


@query("""SELECT k, CASE WHEN k % 7 = 0 THEN 'null' ELSE '[' || concat_ws(',', CASE WHEN k % 5 = 0 THEN '"no location spoken"' END,
    CASE WHEN k % 10 = 0 THEN '"no quantity spoken"' END) || ']' END AS written,
  CASE WHEN k % 7 = 0 OR k % 3 = 0 THEN 0 ELSE (k % 5 = 0)::INT + (k % 10 = 0)::INT END AS n FROM obs""", obs=True)
def reason_texts(spark, d):
    """Reasons as JSON text and back; a null is ``null``, and broken text an empty array."""
    k = F.col("k")
    df = observations(spark, d).select(
        "k", tx.string_array_json(F.when(k % 7 != 0, F.col("review_reasons"))).alias("written"))
    stored = F.when(k % 3 == 0, F.concat(F.lit("broken "), "written")).otherwise(F.col("written"))
    return df.select("k", "written", F.size(tx.string_array_from_json(stored)).alias("n"))


@query("""SELECT event_id, least(event_id * 1000, 480000)::BIGINT AS kept, event_id * 1000 > 480000 AS truncated FROM events""")
def talk_cap(spark, d):
    held = (F.col("event_id") * 1000).cast("long")
    cut = fr.push_to_talk_cap(held)
    return table(spark, d, "events").select("event_id", cut["kept"].cast("long").alias("kept"), cut["truncated"].alias("truncated"))


@query("""SELECT k, round(j + n * 0.1 * (1 - j), 9) AS score FROM (SELECT k, jaro_similarity(a, b) AS j,
    CASE WHEN left(a, 4) = left(b, 4) AND length(a) >= 4 AND length(b) >= 4 THEN 4
      WHEN left(a, 3) = left(b, 3) AND length(a) >= 3 AND length(b) >= 3 THEN 3
      WHEN left(a, 2) = left(b, 2) AND length(a) >= 2 AND length(b) >= 2 THEN 2
      WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END AS n
  FROM (SELECT x.p_partkey AS k, x.p_brand AS a, y.p_brand AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1))""")
def brand_likeness(spark, d):
    """Jaro-Winkler similarity of each part's brand and the next one's."""
    p = table(spark, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("next"))
    return p.join(after, "p_partkey").select(
        F.col("p_partkey").alias("k"), F.round(sim.jaro_winkler("p_brand", "next"), 9).alias("score"))


# --- audio and streaming -----------------------------------------------------


def _clips(spark, d):
    """Short synthetic clips from the embedding vectors: samples are coordinates."""
    e = table(spark, d, "embeddings")
    key, vec = e.columns[0], [c for c, t in e.dtypes if t.startswith("array")][0]
    return e.select(F.col(key).alias("clip_id"), F.transform(
        vec, lambda x: x.cast("float")).alias("pcm"))


@query("""SELECT vec_id AS clip_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))
    / len(embedding)), 5) AS rms,
  round(len(list_filter(range(2, len(embedding) + 1), lambda i: (embedding[i] >= 0) <> (embedding[i-1] >= 0)))
    / (len(embedding) - 1), 6) AS zcr FROM embeddings""")
def frame_rms(spark, d):
    return _clips(spark, d).select(
        "clip_id", F.round(fr.rms(F.col("pcm")), 5).alias("rms"),
        F.round(fr.zero_crossing_rate(F.col("pcm")), 6).alias("zcr"))


@query("""WITH m AS (SELECT vec_id AS clip_id, list_transform(range(len(embedding) // 2),
    lambda i: (embedding[2*i+1]::DOUBLE + embedding[2*i+2]) / 2) AS m FROM embeddings),
  r AS (SELECT *, list_transform(range((len(m) * 3) // 4), lambda i: m[(i*4)//3+1] * (1 - (i*4)%3 / 3.0)
    + coalesce(m[(i*4)//3+2], m[(i*4)//3+1]) * ((i*4)%3 / 3.0)) AS r FROM m)
  SELECT clip_id, len(m)::INTEGER AS mono_samples, len(r)::INTEGER AS samples,
    round(list_sum(m), 3) + 0.0 AS mono_sum, round(list_sum(r), 3) + 0.0 AS sample_sum FROM r""")
def resampled(spark, d):
    c = _clips(spark, d).withColumn("m", fr.mono(F.col("pcm"), F.lit(2)))
    c = c.withColumn("r", fr.resample(F.col("m"), F.lit(48000), F.lit(36000)))

    def total(name):
        return (F.round(F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias(f"{name}_sum")

    return c.select("clip_id", F.size("m").alias("mono_samples"), F.size("r").alias("samples"),
                    total("m").alias("mono_sum"), total("r").alias("sample_sum"))


@query("""WITH f AS (SELECT event_id // 2500 AS clip_id,
    row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) - 1 AS p, (value / 100)::FLOAT::DOUBLE AS x FROM events),
  d AS (SELECT clip_id, p, coalesce(x - lag(x) OVER (PARTITION BY clip_id ORDER BY p), 0) AS dx FROM f),
  y AS (SELECT a.clip_id, a.p, sum(b.dx * pow((1 / (1 + 0.2::DOUBLE * pi()))::FLOAT::DOUBLE, a.p - b.p + 1)) AS y
    FROM d a JOIN d b ON b.clip_id = a.clip_id AND b.p <= a.p AND b.p > a.p - 100 GROUP BY a.clip_id, a.p),
  s AS (SELECT *, (y::FLOAT >= 0) <> lag(y::FLOAT >= 0) OVER (PARTITION BY clip_id, p // 30 ORDER BY p) AS crossed FROM y)
  SELECT clip_id, (p // 30)::INTEGER AS frame_no, round(sqrt(sum(y * y) / 30), 6) AS rms,
    round(count(*) FILTER (crossed) / 29, 6) AS zcr FROM s GROUP BY clip_id, p // 30 HAVING count(*) = 30""")
def high_pass(spark, d):
    """Event values as recordings of 2,500 samples at 1,000 Hz, high-passed at 100 Hz."""
    e = table(spark, d, "events")
    clips = e.groupBy(F.floor(F.col("event_id") / 2500).alias("clip_id")).agg(F.array_sort(F.collect_list(
        F.struct("event_id", (F.col("value") / 100).cast("float").alias("x")))).alias("s"))
    clips = clips.select("clip_id", F.transform("s", lambda s: s["x"]).alias("pcm"))
    return fr.frame_features(clips, 1000, 100.0).select(
        "clip_id", "frame_no", F.round("rms", 6).alias("rms"), F.round("zcr", 6).alias("zcr"))


def _frames(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("event_id") / 500).alias("clip_id"), F.col("event_id").alias("frame_no"),
        F.when(F.floor(F.col("event_id") / 20) % 4 < 2, F.col("value") / 100 + 0.05)
        .otherwise(F.lit(0.002)).alias("rms"), F.lit(0.1).alias("zcr"))


#: the detector's rule frame by frame, all clips at once; one row per frame with what it closes
_VAD_SQL = """WITH RECURSIVE f AS (
  SELECT event_id // 500 AS clip_id, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS p,
    CASE WHEN event_id // 20 % 4 < 2 THEN value / 100 + 0.05::DOUBLE ELSE 0.002::DOUBLE END AS rms, 0.1::DOUBLE AS zcr
  FROM events),
r(clip_id, p, floor, speaking, run, silence, pre, utter, here, closes, s0, s1, truncated) AS (
  SELECT DISTINCT clip_id, 0::BIGINT, NULL::DOUBLE, false, 0, 0, 0, 0, 0, false, 0, 0, false FROM f
  UNION ALL
  SELECT clip_id, p, fl, (speaking AND NOT ends) OR begins,
    CASE WHEN NOT speaking THEN nrun WHEN ends THEN 0 ELSE run END,
    CASE WHEN ends OR begins THEN 0 WHEN speaking THEN quiet ELSE silence END,
    CASE WHEN speaking OR begins THEN 0 ELSE npre END,
    CASE WHEN begins THEN npre WHEN speaking AND NOT ends THEN nutter ELSE 0 END, here + 480, ends,
    here + 480 - nutter, here + 480 - CASE WHEN quiet * 480 <= 1920 OR quiet * 480 - 1920 >= nutter THEN 0
      ELSE quiet * 480 - 1920 END, capped
  FROM (SELECT *, still OR capped AS ends FROM (SELECT *, speaking AND NOT still AND nutter >= 480000 AS capped
    FROM (SELECT *, NOT speaking AND nrun >= 3 AS begins, speaking AND quiet * 30 >= 700 AS still
    FROM (SELECT *, CASE WHEN speech THEN run + 1 ELSE 0 END AS nrun, CASE WHEN speech THEN 0 ELSE silence + 1 END AS quiet
    FROM (SELECT *, rms >= greatest(fl * 2.5::DOUBLE, 0.010::DOUBLE) AND zcr <= 0.35 AND zcr >= 0.02 AS speech
    FROM (SELECT r.clip_id, f.p, rms, zcr, speaking, run, silence, here, least(pre + 480, 4800) AS npre, utter + 480 AS nutter,
      CASE WHEN floor IS NULL THEN least(rms, 0.010::DOUBLE) WHEN rms < floor THEN rms
        ELSE floor + (rms - floor) * CASE WHEN speaking THEN 0.0005::DOUBLE ELSE 0.004::DOUBLE END END AS fl
      FROM r JOIN f ON f.clip_id = r.clip_id AND f.p = r.p + 1))))))),
g AS (
  SELECT clip_id, p, s0, s1, truncated FROM r WHERE closes UNION ALL
  SELECT clip_id, p + 1, here - utter, here - CASE WHEN silence * 480 <= 1920 OR silence * 480 - 1920 >= utter THEN 0
    ELSE silence * 480 - 1920 END, false
  FROM r WHERE speaking AND utter > 0 AND p = (SELECT max(p) FROM f WHERE f.clip_id = r.clip_id))
"""
_SEGMENT_ROWS = """SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY p) - 1)::INTEGER AS utt_no,
  s0::BIGINT AS start_sample, s1::BIGINT AS end_sample, truncated FROM g"""


@query(_VAD_SQL + _SEGMENT_ROWS)
def vad_segments(spark, d):
    return fr.vad_segments(_frames(spark, d))


@query(_VAD_SQL + "SELECT clip_id, sum(s1 - s0)::BIGINT AS speech_samples FROM g GROUP BY clip_id")
def vad_trimmed(spark, d):
    return fr.trimmed_length(fr.vad_segments(_frames(spark, d)))


@query(_VAD_SQL + _SEGMENT_ROWS)
def vad_stream(spark, d):
    """The frames as two pushes that part every recording at frame 237; a late heartbeat ends what is open."""
    root = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    place = F.col("frame_no") % 500
    frames = _frames(spark, d).withColumn("at", F.timestamp_millis((946684800000 + place * 30).cast("long")))
    heartbeat = spark.range(1).select(
        F.lit(-1).cast("long").alias("clip_id"), F.lit(499).cast("long").alias("frame_no"), F.lit(0.0).alias("rms"),
        F.lit(0.1).alias("zcr"), F.timestamp_seconds(F.lit(946688400)).alias("at"))
    for n, push in enumerate((frames.where(place < 237), frames.where(place >= 237).unionByName(heartbeat))):
        push.write.parquet(f"{root}/frames/push-{n}")
        segments.run_segments(spark.readStream.schema(push.schema).parquet(f"{root}/frames/*"), root, f"{root}/checkpoint")
    return segments.read_segments(spark, root)


@query("""SELECT o_orderkey AS k, status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'rejected'
  WHEN o_orderstatus = 'O' THEN 'draft' WHEN o_orderstatus = 'P' THEN 'confirmed' ELSE 'synced' END AS status
  FROM orders) WHERE o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0""")
def stream_ingest(spark, d):
    """The order table as a stream: validated, logged, merged and tombstoned."""
    batch = table(spark, d, "orders")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    from tallyline.plans.corpus import record_id
    rows = stream.select(
        k.alias("k"), record_id(at, k).alias("id"), at.alias("captured_at"), F.lit("en").alias("language"),
        F.concat(F.lit("dev-"), (F.col("o_custkey") % 20).cast("string")).alias("device_id"),
        F.when(k % 11 == 0, "rejected").when(F.col("o_orderstatus") == "O", "draft").when(
            F.col("o_orderstatus") == "P", "confirmed").otherwise("synced").alias("status"),
        F.struct(F.when(k % 23 == 0, -1.0).otherwise(1.0).alias("quantity")).alias("parsed"),
        F.struct(*[F.lit(1.0).alias(n) for n in ("asr", "quantity", "location", "item")]).alias("confidence"),
        F.lit(1).alias("schema_version"))
    accepted, _ = ingest.ingest_once(rows)
    voids = accepted.where("k % 29 = 0").select("id")
    return ingest.current_records(accepted, voids).select("k", "status")


def _in_three_pushes(df, at="captured_at"):
    """Which of three pushes brings a row, by its year."""
    return df.withColumn("push", F.when(F.year(at) < 1994, 0).when(F.year(at) < 1997, 1).otherwise(2))


@query("""SELECT k, outcome, count(*) AS n FROM (
    SELECT k, CASE WHEN k % 31 = 0 AND year(captured_at) < 1994 AND captured_at <= w THEN 'late' ELSE 'accepted' END AS outcome
    FROM obs, (SELECT max(captured_at) - INTERVAL 2 DAY AS w FROM obs WHERE year(captured_at) < 1997
               AND NOT (k % 31 = 0 AND year(captured_at) < 1994)))
  GROUP BY k, outcome""", obs=True)
def bounded_ingest(spark, d):
    """Orders pushed in three parts: a seventh is sent twice in its part, some of the first come with the last."""
    root = f"{shared_dir(spark)}/bounded-{uuid.uuid4().hex}"
    rows = _in_three_pushes(observations(spark, d))
    held = (F.col("k") % 31 == 0) & (F.col("push") == 0)
    sent = rows.withColumn("push", F.when(held, 2).otherwise(F.col("push")))
    sent = cut_lineage(sent.unionAll(sent.where("k % 7 = 0")))
    arrived = sent.drop("push")
    for push in range(3):
        sent.where(F.col("push") == push).drop("push").write.parquet(f"{root}/inbox/push-{push}")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{root}/inbox/*")
        ingest.run_bounded_ingest(stream, root, f"{root}/checkpoint", "2 days")
    accepted, rejected = ingest.read_logs(spark, root, arrived.schema)
    late = ingest.late_rows(arrived, accepted, rejected)
    outcome = accepted.select("k", F.lit("accepted").alias("outcome")).unionAll(late.select("k", F.lit("late")))
    return outcome.groupBy("k", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT k, captured_at + to_minutes((k % 120)::INT) AS edited_at, captured_at + INTERVAL 1 HOUR AS acked_at
  FROM obs WHERE k % 4 = 0 AND status = 'rejected' AND k % 120 <= 60""", obs=True)
def in_flight_voids(spark, d):
    """Every fourth record is pushed when captured and acknowledged an hour later; rejections come up to two hours on."""
    root = f"{shared_dir(spark)}/inflight-{uuid.uuid4().hex}"
    records = observations(spark, d).select("id", "status", "captured_at", "k")
    later = F.make_dt_interval(mins=(F.col("k") % 120).cast("int"))
    acks = records.where("k % 4 = 0").select(
        "id", F.col("captured_at").alias("sent_at"), (F.col("captured_at") + F.expr("INTERVAL 1 HOUR")).alias("acked_at"))
    edits = records.select("id", "status", (F.col("captured_at") + later).alias("edited_at"))
    acks.write.parquet(f"{root}/acks")
    edits.write.parquet(f"{root}/edits")
    ingest.run_in_flight(
        spark.readStream.schema(acks.schema).parquet(f"{root}/acks"),
        spark.readStream.schema(edits.schema).parquet(f"{root}/edits"), root, f"{root}/checkpoint")
    found = ingest.read_voids(spark, root)
    return found.join(records.select("id", "k"), "id").select("k", "edited_at", "acked_at")


@query("""SELECT device_id, min(captured_at) AS "start", max(captured_at) + INTERVAL 30 MINUTE AS "end", count(*) AS n
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY captured_at, k) AS shift
    FROM (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY device_id ORDER BY captured_at, k)
      <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM obs)) GROUP BY device_id, shift""", obs=True)
def shift_summary(spark, d):
    return an.shift_summary(observations(spark, d))

