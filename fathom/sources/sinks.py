"""Sinks: CSV reports, percentile rows, idempotent content-addressed puts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_address


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_event_log(events: DataFrame, path: str, append: bool = False) -> None:
    events.select(F.concat_ws(",", "event", "task", "ts_ns")).write.mode("append" if append else "overwrite").text(path)


def micros(ns: Column) -> Column:
    return F.round(ns / 1000, 3)


def put_blobs(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows (address, payload) to add: one per new address."""
    new = payloads.select(content_address(F.col("payload")).alias("address"), "payload").dropDuplicates(["address"])
    return new.join(stored.select("address"), "address", "left_anti")


def percentile_row(found: DataFrame, label: str) -> DataFrame:
    """A row of percentiles in nanoseconds as label, count and microseconds."""
    us = {"min_ns": "min_us", "p50": "p50_us", "p99": "p99_us", "p999": "p999_us", "max_ns": "max_us", "mean_ns": "mean_us"}
    return found.select(F.lit(label).alias("label"), "count", *(micros(F.col(a)).alias(b) for a, b in us.items()))


def write_study(folder: str, scores: DataFrame, threshold: float, calibration: str, held_out: str) -> None:
    """The artefacts of an error-rate study: all scores, the calibration sweep, the threshold, held-out rates and rates by stratum.

    scores has stratum, part, segment, class and score.
    """
    from ..functions.udfs import binomial_interval
    from ..operators import analytics

    write_csv(scores.select("stratum", "part", "segment", "class", F.round("score", 6).alias("score")), f"{folder}/scores")
    swept = analytics.sweep(scores.where(F.col("part") == calibration)).orderBy("threshold")
    write_csv(swept.select(F.round("threshold", 6).alias("threshold"), F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"), "false_accepts", "attacks", "false_rejects", "honest"), f"{folder}/calibration")
    spark = scores.sparkSession
    spark.createDataFrame([(threshold, "criterion=youden_j", "youden_j")], "value double, provenance string, criterion string").coalesce(1).write.mode("overwrite").json(f"{folder}/threshold")
    held = scores.where(F.col("part") == held_out)
    ci = binomial_interval()
    rates = analytics.error_rates(held, F.lit(threshold))
    rows = F.explode(F.array(F.struct(F.lit("FAR").alias("metric"), F.col("false_accepts").alias("events"), F.col("attacks").alias("total")), F.struct(F.lit("FRR").alias("metric"), F.col("false_rejects").alias("events"), F.col("honest").alias("total"))))
    with_interval = lambda df: df.withColumn("ci", ci("events", "total")).select(*df.columns, F.try_divide("events", "total").alias("rate"), F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))
    write_csv(with_interval(rates.select(rows.alias("r")).select("r.*")), f"{folder}/held_out")
    by = analytics.error_rates(held, F.lit(threshold), "stratum").select("stratum", F.col("false_rejects").alias("events"), F.col("honest").alias("total"))
    write_csv(with_interval(by), f"{folder}/strata")
