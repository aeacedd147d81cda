"""Record, utterance and event corpora derived from the star-schema tables.

The generator shares nothing with the extraction grammar: texts are built from
columns, so extracting them must give the columns back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.session import configure, dealt, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- records ---------------------------------------------------------------

OBS_SQL = """obs AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN id || '.wav' END AS audio_ref,
    CASE WHEN status = 'synced' THEN captured_at + to_days((k % 30)::INT) END AS synced_at,
    CASE WHEN status = 'confirmed' AND k % 13 = 0 THEN 'duplicate' END AS sync_rejected_reason
  FROM (SELECT k, captured_at, device_id, operator_id, language, quantity, unit, item_text,
      part_number, location_text, location_id, c_asr, c_quantity, c_location, c_item,
      needs_review, status, raw_transcript,
      printf('%08x-%04x-7000-8000-%012x', epoch_ms(captured_at) // 65536,
             epoch_ms(captured_at) % 65536, k) AS id
    FROM (SELECT o_orderkey AS k,
        o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS captured_at,
        'dev-' || (o_custkey % 20) AS device_id, 'op-' || (o_custkey % 7) AS operator_id,
        CASE WHEN o_orderkey % 8 = 7 THEN 'es' ELSE 'en' END AS language,
        CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 50) / CASE WHEN o_orderkey % 4 = 1
          THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END AS quantity,
        CASE WHEN o_orderkey % 6 <> 0 THEN 'boxes' END AS unit,
        'item ' || (o_orderkey % 64) AS item_text,
        CASE WHEN o_orderkey % 9 <> 0 THEN 'PN-' || (o_orderkey % 64) END AS part_number,
        CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE chr((65 + o_orderkey % 26)::INT) || '-'
          || (o_orderkey % 40) END AS location_text,
        CASE WHEN o_orderkey % 11 <> 1 AND o_orderkey % 17 <> 0 THEN 'LOC-'
          || chr((65 + o_orderkey % 26)::INT) || '-' || (o_orderkey % 40) END AS location_id,
        (o_orderkey % 100) / 100.0::DOUBLE AS c_asr, (o_orderkey % 90) / 90.0::DOUBLE AS c_quantity,
        (o_orderkey * 7 % 100) / 100.0::DOUBLE AS c_location,
        (o_orderkey * 3 % 100) / 100.0::DOUBLE AS c_item,
        o_orderkey % 5 = 0 AS needs_review,
        CASE WHEN o_orderkey % 11 = 0 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'draft'
          WHEN o_orderstatus = 'P' THEN 'confirmed' ELSE 'synced' END AS status,
        o_orderpriority || ', "' || o_orderkey || '"' AS raw_transcript
      FROM orders)))"""


def record_id(captured_at: Column, key: Column) -> Column:
    """Time-ordered id: milliseconds first, then the key."""
    ms = F.unix_millis(captured_at)
    return F.format_string("%08x-%04x-7000-8000-%012x", F.floor(ms / 65536), ms % 65536, key)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400)
    place = F.concat(F.chr(65 + k % 26), F.lit("-"), (k % 40).cast("string"))
    status = (
        F.when(k % 11 == 0, "rejected").when(F.col("o_orderstatus") == "O", "draft")
        .when(F.col("o_orderstatus") == "P", "confirmed").otherwise("synced")
    )
    df = o.select(
        k.alias("k"), at.alias("captured_at"), record_id(at, k).alias("id"),
        F.concat(F.lit("dev-"), (F.col("o_custkey") % 20).cast("string")).alias("device_id"),
        F.concat(F.lit("op-"), (F.col("o_custkey") % 7).cast("string")).alias("operator_id"),
        F.when(k % 8 == 7, "es").otherwise("en").alias("language"),
        F.concat("o_orderpriority", F.lit(', "'), k.cast("string"), F.lit('"')).alias("raw_transcript"),
        F.struct(
            F.concat(F.lit("item "), (k % 64).cast("string")).alias("item_text"),
            F.when(k % 9 != 0, F.concat(F.lit("PN-"), (k % 64).cast("string"))).alias("part_number"),
            F.when(k % 10 != 0, (k % 50) / F.when(k % 4 == 1, 2.0).otherwise(1.0)).alias("quantity"),
            F.when(k % 6 != 0, "boxes").alias("unit"),
            F.when(k % 17 == 0, "").otherwise(place).alias("location_text"),
            F.when((k % 11 != 1) & (k % 17 != 0), F.concat(F.lit("LOC-"), place)).alias("location_id"),
            F.lit(None).cast("string").alias("description"),
        ).alias("parsed"),
        F.struct(
            ((k % 100) / 100.0).alias("asr"), ((k % 90) / 90.0).alias("quantity"),
            ((k * 7 % 100) / 100.0).alias("location"), ((k * 3 % 100) / 100.0).alias("item"),
        ).alias("confidence"),
        status.alias("status"), (k % 5 == 0).alias("needs_review"),
        F.array_compact(F.array(
            F.when(k % 5 == 0, "no location spoken"), F.when(k % 10 == 0, "no quantity spoken"),
        )).alias("review_reasons"),
        F.lit(1).alias("schema_version"),
    )
    return df.withColumns({
        "audio_ref": F.when(F.col("k") % 3 == 0, F.concat("id", F.lit(".wav"))),
        "synced_at": F.when(F.col("status") == "synced", F.col("captured_at")
                            + F.make_dt_interval(days=(F.col("k") % 30).cast("int"))),
        "sync_rejected_reason": F.when(
            (F.col("status") == "confirmed") & (F.col("k") % 13 == 0), "duplicate"),
        "sync_rejected_at": F.lit(None).cast("timestamp"),
    })


# --- corrections -----------------------------------------------------------

LOG_SQL = """log AS (
  SELECT o.id AS observation_id, l_linenumber * 1000000 + rank() OVER (
      PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS pos,
    CASE l_linenumber % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'quantity' ELSE 'item' END AS field,
    'was ' || l_suppkey AS from_value, 'now ' || l_partkey || ' ' || l_extendedprice::DECIMAL(18,2)
      AS to_value, l_shipdate::TIMESTAMP AS at, l_orderkey AS k
  FROM (SELECT DISTINCT * FROM lineitem) JOIN obs o ON o.k = l_orderkey)"""


def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction log rows from line items; ``pos`` orders equal times.

    Dealt by order into tasks of bounded rows: removing copies, ranking and the join all
    keep that exchange, and no task grows with the table.
    """
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(li)
    li = li.repartition(tasks, "l_orderkey").distinct().withColumn("_r", F.rank().over(w))
    ids = observations(spark, sf_dir).select("k", F.col("id").alias("observation_id")).repartition(tasks, "k")
    return li.join(ids, F.col("l_orderkey") == F.col("k")).select(
        "observation_id", (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("_r")).alias("pos"),
        F.when(F.col("l_linenumber") % 3 == 0, "location").when(
            F.col("l_linenumber") % 3 == 1, "quantity").otherwise("item").alias("field"),
        F.concat(F.lit("was "), F.col("l_suppkey").cast("string")).alias("from_value"),
        F.concat(F.lit("now "), F.col("l_partkey").cast("string"), F.lit(" "),
                 F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("to_value"),
        F.col("l_shipdate").cast("timestamp").alias("at"), "k")


# --- utterances ------------------------------------------------------------

_SMALL = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
          "fifteen sixteen seventeen eighteen nineteen").split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spoken(n: Column) -> Column:
    """English words of a whole number from 1 to 999,999."""
    small = F.array(*map(F.lit, _SMALL))
    tens = F.array(*map(F.lit, _TENS))

    def below_hundred(x: Column) -> Column:
        return F.when(x < 20, F.get(small, (x - 1).cast("int"))).otherwise(F.concat_ws(
            " ", F.get(tens, (x / 10 - 2).cast("int")), F.get(small, (x % 10 - 1).cast("int"))))

    def below_thousand(x: Column) -> Column:
        return F.concat_ws(
            " ", F.when(x >= 100, F.concat(
                F.get(small, (x / 100 - 1).cast("int")), F.lit(" hundred"))),
            F.when(x % 100 > 0, below_hundred(x % 100)))

    high = (n / 1000).cast("int")
    return F.trim(F.concat_ws(
        " ", F.when(high > 0, F.concat(below_thousand(high), F.lit(" thousand"))),
        F.when(n % 1000 > 0, below_thousand(n % 1000))))


UTT_SQL = """utt AS (
  SELECT o_orderkey AS utt_id, o_orderkey % 8 AS variant,
    'dev-' || (o_custkey % 20) AS device_id,
    (o_orderkey % 900 + 1)::DOUBLE AS q, p_name AS name, p_partkey AS partkey,
    chr((65 + o_orderkey % 26)::INT) AS letter, o_orderkey % 90 + 1 AS num,
    (o_orderkey % 100) / 100.0::DOUBLE AS asr
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
said AS (
  SELECT *, CASE WHEN variant IN (3, 6) THEN NULL ELSE q END AS quantity,
    CASE WHEN variant = 3 THEN NULL WHEN variant = 7 THEN 'cajas' ELSE 'boxes' END AS unit,
    CASE WHEN variant = 6 THEN 'aisle ' || num || ' / shelf ' || (num % 7 + 1)
      ELSE letter || '-' || num END AS location,
    variant = 2 AS approx, variant = 6 AS vague
  FROM utt)"""


def orders_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with a part; together they name all parts, each equally often."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    return o.select("o_orderkey", "o_custkey").join(
        p.select("p_partkey", "p_name", "p_type"), F.col("o_orderkey") % p.count() == F.col("p_partkey"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One utterance per order, in eight phrasings."""
    k = F.col("o_orderkey")
    df = dealt(orders_with_parts(spark, sf_dir), "o_orderkey").select(
        k.alias("utt_id"), (k % 8).alias("variant"),
        F.concat(F.lit("dev-"), (F.col("o_custkey") % 20).cast("string")).alias("device_id"),
        (k % 900 + 1).alias("q"), F.col("p_name").alias("name"), F.col("p_partkey").alias("partkey"),
        F.chr(65 + k % 26).alias("letter"), (k % 90 + 1).alias("num"),
        ((k % 100) / 100.0).alias("asr_confidence"), (k % 97 == 0).alias("truncated"))
    v, q = F.col("variant"), F.col("q")
    place = F.concat("letter", F.lit("-"), F.col("num").cast("string"))
    name, words = F.col("name"), spoken(q)

    def say(*parts) -> Column:
        return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    digits = q.cast("string")
    text = (
        F.when(v == 0, say(words, " boxes of ", name, " in bin ", place))
        .when(v == 1, say("Bin ", place, ", ", words, " boxes of ", name))
        .when(v == 2, say("about ", digits, " boxes of ", name, " in bin ", place, "."))
        .when(v == 3, say(name, " in bin ", F.col("letter"), " ", F.col("num").cast("string")))
        .when(v == 4, say(words, " boxes of ", name, " in bin Z-99, no, ", place))
        .when(v == 5, say(spoken(q + 1), " boxes of ", name, " in bin ", place, ", I mean ", words))
        .when(v == 6, say("several boxes of ", name, " in aisle ", spoken(F.col("num")),
                          " shelf ", (F.col("num") % 7 + 1).cast("string")))
        .otherwise(say(digits, " cajas de ", name, " en el bin ", place))
    )
    return df.select(
        "utt_id", "variant", "device_id", "asr_confidence", "truncated", "partkey",
        F.when(v == 7, "es").otherwise("en").alias("lang"), text.alias("text"))


def part_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names as a vocabulary; the smallest key names a part."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("m")).select(
        F.format_string("PN-%06d", "m").alias("part_number"), F.col("p_name").alias("name"),
        F.array(F.concat("p_name", F.lit("s"))).alias("aliases"))


PARTS_SQL = """parts AS (
  SELECT printf('PN-%06d', min(p_partkey)) AS part_number, p_name AS name FROM part GROUP BY p_name)"""


def location_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins seen in the orders: letter and number."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    code = F.concat(F.chr(65 + k % 26), F.lit("-"), (k % 90 + 1).cast("string"))
    return o.select(code.alias("code")).distinct().select(
        F.concat(F.lit("LOC-"), "code").alias("id"), F.concat(F.lit("Bin "), "code").alias("name"),
        F.array("code").alias("aliases"))
