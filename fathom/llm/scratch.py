"""Tables that cut lineage, kept in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that Spark hands to a Python worker at once; its own default has no bound.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batch size in bytes, where the user hasn't: rows of a batch may be long texts."""
    if int(spark.conf.get(_BATCH, "2147483647")) == 2**31 - 1:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session takes a folder of its machine; a cluster has none to take."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a stage boundary that survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions that the session deals a shuffle to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    bound_batches(docs.sparkSession)
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def parts(spark: SparkSession, total: int, size: int) -> int:
    """How many groups of about size bytes a total makes, twice the session's width at least."""
    return max(2 * width(spark), -(-total // size))
