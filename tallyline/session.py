"""Session settings the operators rely on."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

SETTINGS = {
    # timestamps are UTC instants; formatting must not depend on the host
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: small sides turn into broadcasts once their size is
    # known, hot partitions of joins are split
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles methods above 8000 bytes; long projection chains
    # run faster as separate operators than as one interpreted loop
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        # call-site capture on every Column operation slows down plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for lineage cuts.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    Used where several consumers would each repeat an expensive plan; a lost
    executor costs a re-read of files, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Narrow rows dealt by key ahead of text extraction, over every core at least.

    Extraction takes about a millisecond a row; dealing the rows costs a
    thousandth of it. The count is explicit: rows this narrow would otherwise be
    packed by bytes into one or two tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


#: rows a task of a counted table gets
TASK_ROWS = 250_000


def tasks_for(counted: DataFrame) -> int:
    """Tasks that keep a table's rows per task bounded, at least Spark's own number.

    Counts the rows, which a parquet file answers from its footer.
    """
    return max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               math.ceil(counted.count() / TASK_ROWS))
