"""Counts of a stream's rows as Spark observes them, written to an event log."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = "query string, batch long, metric string, counts map<string, long>"


def observed(rows: DataFrame, metric: str, **counts: Column) -> DataFrame:
    """rows, of which each micro-batch reports how many there are and for how many each condition holds."""
    return rows.observe(metric, F.count("*").alias("rows"), *(F.count_if(c).alias(name) for name, c in counts.items()))


class EventLog(StreamingQueryListener):
    """Appends the observed counts of every micro-batch that had any to a folder of JSON lines; without a folder it does nothing."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.session, self.folder = spark, folder

    def record(self, query: str, batch: int, metrics: Mapping[str, Mapping[str, int]]) -> None:
        rows = [(query, batch, name, {k: int(v) for k, v in counts.items()}) for name, counts in metrics.items()]
        if self.folder and rows:
            self.session.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(self.folder)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        said = json.loads(event.progress.json).get("observedMetrics", {})
        self.record(event.progress.name or str(event.progress.id), event.progress.batchId, {k: v for k, v in said.items() if v and v.get("rows") is not None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """query, batch, metric and counts; a batch that was told twice, as after a restart, counts once."""
    return spark.read.schema(LOG).json(folder).groupBy("query", "batch", "metric").agg(F.max_by("counts", F.col("counts")["rows"]).alias("counts"))
