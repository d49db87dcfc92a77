"""A table of rows by key, fed by micro-batches, in which the last write wins and a replayed batch changes nothing.

Each batch is a folder named by its number, written as a whole: a replay writes
the same folder again. Readers take, of each key, the row of the latest batch.
``compact`` folds the batches up to one into a base; only a mark written after
the base makes readers start from it, so a compaction that dies is no loss.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select("row.*")


def upsert(folder: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch; of rows of one key in a batch that of greatest order counts."""

    def write(batch: DataFrame, number: int) -> None:
        _last(batch, keys, [*order, *(c for c in batch.columns if c not in order)], batch.columns).write.mode("overwrite").parquet(f"{folder}/kind=delta/batch={number}")

    return write


def _marked(spark: SparkSession, folder: str) -> int:
    """The batch up to which a whole base exists, else -1."""
    try:
        return spark.read.schema("upto long").parquet(f"{folder}_marks").agg(F.max("upto")).first()[0]
    except Exception as e:  # the folder is known to be missing only when Spark resolves it
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1


def _held(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    base = _marked(spark, folder)
    rows = spark.read.schema(f"{columns}, kind string, batch long").parquet(folder)
    return rows.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "delta") & (F.col("batch") > base)))


def current(spark: SparkSession, folder: str, keys: Sequence[str], columns: str) -> DataFrame:
    """The row of each key that was written last; columns is the schema of the rows."""
    rows = _held(spark, folder, columns)
    return _last(rows, keys, ["batch"], [c for c in rows.columns if c not in ("kind", "batch")])


def compact(spark: SparkSession, folder: str, keys: Sequence[str], columns: str, upto: int) -> None:
    """Fold base and batches up to one into the next base."""
    rows = _held(spark, folder, columns).where(F.col("batch") <= upto)
    _last(rows, keys, ["batch"], [c for c in rows.columns if c not in ("kind", "batch")]).write.mode("overwrite").parquet(f"{folder}/kind=base/batch={upto}")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{folder}_marks")
