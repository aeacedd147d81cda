"""Readers and writers; every reader takes an explicit schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyline import schema
from tallyline.functions.text import clamp01, trim_space
from tallyline.operators.analytics import snapshot_digest
from tallyline.operators.records import csv_rows


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.OBSERVATION_ROW).parquet(path)


def write_observations(df: DataFrame, path: str) -> None:
    """Record table by capture date, sorted by id inside the files."""
    (df.withColumn("capture_date", F.to_date("captured_at"))
     .repartitionByRange("capture_date", "id")
     .sortWithinPartitions("capture_date", "id")
     .write.partitionBy("capture_date").mode("append").parquet(path))


def read_dimension(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON array of locations, parts or units."""
    shape = {"locations": schema.LOCATION, "parts": schema.PART, "units": schema.UNIT}[kind]
    return spark.read.schema(shape).option("multiLine", True).json(path)


def read_refdata(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three dimensions of one combined document."""
    doc = spark.read.schema(schema.REFDATA).option("multiLine", True).json(path)
    return explode_refdata(doc)


def explode_refdata(doc: DataFrame) -> dict[str, DataFrame]:
    return {k: doc.select(F.inline(k)) for k in ("locations", "parts", "units")}


_POINTER = "version long, n long, digest long"


def current_snapshot(spark: SparkSession, root: str) -> Row | None:
    """The pointer ``(version, n, digest)`` of the newest complete snapshot, or nothing yet."""
    try:
        return spark.read.schema(_POINTER).parquet(f"{root}/pointer").orderBy(F.desc("version")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{current_snapshot(spark, root).version}")


def refresh_snapshot(df: DataFrame, root: str) -> str:
    """Replace a dimension if its content changed: ``modified`` or ``not_modified``.

    The data go beside the old version; then one row in the pointer table makes
    them current. Readers see the old snapshot or the new one, never a part.
    """
    spark = df.sparkSession
    now, old = snapshot_digest(df).first(), current_snapshot(spark, root)
    if old and (old.n, old.digest) == (now.n, now.digest):
        return "not_modified"
    version = old.version + 1 if old else 1
    df.write.mode("overwrite").parquet(f"{root}/data/{version}")
    spark.createDataFrame([(version, now.n, now.digest)], _POINTER).write.mode("append").parquet(f"{root}/pointer")
    return "modified"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Records of uploaded device batches."""
    return explode_batches(spark.read.schema(schema.BATCH).json(path))


def explode_batches(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.col("device_id").alias("batch_device_id"),
                      F.explode("observations").alias("o"))
    return rows.select("batch_device_id", "o.*")


def transcript_columns(raw: Column) -> dict[str, Column]:
    """Text, language, mean token probability and tokens of a transcript document."""
    doc = F.from_json(raw, schema.TRANSCRIPT)
    segments = F.coalesce(doc["transcription"], F.array().cast(
        schema.TRANSCRIPT["transcription"].dataType))
    tokens = F.flatten(F.transform(segments, lambda s: F.coalesce(
        s["tokens"], F.array().cast(schema.TRANSCRIPT["transcription"].dataType.elementType["tokens"].dataType))))
    spoken = F.filter(tokens, lambda t: ~trim_space(t["text"]).rlike(r"^(\[_|<\|)"))
    kept = F.transform(spoken, lambda t: F.struct(
        t["text"].alias("text"), t["offsets"]["from"].alias("start_ms"),
        t["offsets"]["to"].alias("end_ms"), clamp01(t["p"]).alias("confidence")))
    return {
        "text": trim_space(F.array_join(F.transform(
            segments, lambda s: F.coalesce(s["text"], F.lit(""))), "")),
        "language": F.coalesce(doc["result"]["language"], F.lit("")),
        "tokens": kept,
    }


def read_transcripts(df: DataFrame, raw: str = "json") -> DataFrame:
    """Add ``text``, ``language``, ``tokens`` and ``asr_confidence``."""
    df = df.withColumns(transcript_columns(F.col(raw)))
    mean = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size("tokens")
    return df.withColumn("asr_confidence", F.when(F.size("tokens") > 0, mean).otherwise(0.0))


def write_csv(df: DataFrame, path: str) -> None:
    """Export with header; no field is trimmed, null is the empty string."""
    (csv_rows(df).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per record, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "id", buckets: int | None = None) -> DataFrame:
    """Write records as an external table bucketed and sorted by key; joins on the key don't shuffle it.

    Without a number there are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.mode("overwrite").option("path", path).bucketBy(n, key).sortBy(key)
     .saveAsTable(name))
    return spark.table(name)
