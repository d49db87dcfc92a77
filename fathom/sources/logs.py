"""Event logs as text, thresholds and keys: sources that drop or refuse malformed input as defined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """event, task and ts_ns of lines event,task,ns; other lines are dropped. Commas past the second make a line malformed."""
    parts = F.split(F.col(column), ",", 3)
    field = lambda k: F.trim(F.get(parts, F.lit(k)))
    out = lines.select(field(0).alias("event"), field(1).try_cast("bigint").alias("task"), field(2).try_cast("bigint").alias("ts_ns"))
    return out.where((F.col("event") != "") & F.col("task").isNotNull() & F.col("ts_ns").isNotNull())


def read_event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All *.log files of a folder; a missing folder is empty."""
    try:
        lines = spark.read.option("pathGlobFilter", "*.log").text(folder)
    except Exception as e:  # the path is known to be missing only when Spark resolves it
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return parse_events(lines)


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    """value and provenance of a threshold file; malformed files are refused, unknown fields ignored."""
    found = spark.read.schema("value double, provenance string").option("mode", "FAILFAST").option("multiLine", True).json(path)
    return found.select(F.when(F.col("value").isNull(), F.raise_error(F.lit("threshold without value"))).otherwise(F.col("value")).alias("value"), "provenance")


def read_keys(spark: SparkSession, folder: str) -> DataFrame:
    """job, segment and key of {job}-{segment}.key files; other names are skipped, a key that isn't 32 bytes is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.key").load(folder)
    name = F.regexp_extract("path", r"/(\d+)-(\d+)\.key$", 0)
    files = files.where(name != "")
    key = F.when(F.length("content") != 32, F.raise_error(F.lit("key is not 32 bytes")).cast("binary")).otherwise(F.col("content"))
    return files.select(F.regexp_extract("path", r"/(\d+)-(\d+)\.key$", 1).cast("bigint").alias("job"), F.regexp_extract("path", r"/(\d+)-(\d+)\.key$", 2).cast("bigint").alias("segment"), key.alias("key"))
