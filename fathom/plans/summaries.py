"""Registered summaries of measurements, with their SQL twins.

Measured times stand in the driver's tables as prices and quantities: a line's
ship mode of work is its flag (profile) and status (segment).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, exchange
from ..operators.ordered import in_order
from ..sources import sinks
from ..sources import tables as T
from .catalog import query

_TIMES = "SELECT l_returnflag AS profile, l_linestatus AS segment, l_linenumber AS concurrency, CAST(round(l_extendedprice * 100) AS BIGINT) AS work_ns, CAST(round(l_quantity * 1000) AS BIGINT) AS crypto_ns, CAST(round(l_extendedprice * (1 + l_tax) * 250) AS BIGINT) AS verify_ns FROM lineitem"


def _times(spark, d):
    return T.derived(spark, d, _TIMES)


_RANKED = "r AS (SELECT {0}, {1} AS v, row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1 AS k, count(*) OVER (PARTITION BY {0}) AS n FROM t)"


@query(f"WITH t AS ({_TIMES}) SELECT concurrency, count(*) AS samples, quantile_disc(ppm, 0.5)::BIGINT AS p50_ppm, quantile_disc(ppm, 0.99)::BIGINT AS p99_ppm, round(quantile_disc(ppm, 0.5) / 10000.0, 4)::DOUBLE AS p50_pct FROM (SELECT concurrency, CASE WHEN crypto_ns + work_ns > 0 THEN crypto_ns * 1000000 // (crypto_ns + work_ns) ELSE 0 END AS ppm FROM t) GROUP BY concurrency")
def crypto_share(spark, d):
    """The share of sealing in all work, in parts per million, by concurrency."""
    rows = _times(spark, d).withColumn("ppm", scalars.parts_per_million(F.col("crypto_ns"), F.col("crypto_ns") + F.col("work_ns")))
    by = analytics.discrete(rows, {"p50_ppm": ("ppm", 0.5), "p99_ppm": ("ppm", 0.99)}, "concurrency", aggregates=[F.count("*").alias("samples")])
    return by.withColumn("p50_pct", F.round(F.col("p50_ppm") / 10000, 4))


@query(f"WITH t AS ({_TIMES}) SELECT profile, count(*) AS samples, round(quantile_disc(verify_ns, 0.5) / greatest(quantile_disc(work_ns, 0.5), 1), 6)::DOUBLE AS ratio, count(*) FILTER (verify_ns <= 3 * work_ns) AS passed FROM t GROUP BY profile")
def verify_cost(spark, d):
    """Median time of checking over median time of the work itself, and how many checks passed."""
    plain = [F.count("*").alias("samples"), F.count_if(F.expr("verify_ns <= 3 * work_ns")).alias("passed")]
    by = analytics.discrete(_times(spark, d), {"v": ("verify_ns", 0.5), "w": ("work_ns", 0.5)}, "profile", aggregates=plain)
    return by.select("profile", "samples", F.round(F.col("v") / F.greatest("w", F.lit(1)), 6).alias("ratio"), "passed")


@query("SELECT round(avg(CASE WHEN a > 0 THEN b / a ELSE 0 END), 6) AS encode_ratio, round(avg(CASE WHEN pairs > 0 THEN b / pairs * 1000 ELSE 0 END), 6) AS per_pair_ms, count(*) AS clips FROM (SELECT ps.p_brand AS clip, sum(CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END) AS a, sum(p_retailprice) AS b, count(*) FILTER (p_size > 40) AS pairs FROM part ps GROUP BY 1)")
def cost_means(spark, d):
    """Means over clips of cost ratios; a ratio with nothing below counts as 0."""
    part = T.table(spark, d, "part")
    clips = part.groupBy(F.col("p_brand").alias("clip")).agg(F.sum(F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(0.0)).alias("a"), F.sum("p_retailprice").alias("b"), F.count_if(F.col("p_size") > 40).alias("pairs"))
    ratio = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return clips.agg(F.round(ratio(F.try_divide("b", "a")), 6).alias("encode_ratio"), F.round(ratio(F.try_divide("b", "pairs") * 1000), 6).alias("per_pair_ms"), F.count("*").alias("clips"))


_SUMMARY = """WITH t AS ({times}), a AS (SELECT profile, segment, work_ns FROM t UNION ALL SELECT profile, 'ALL', work_ns FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY profile, segment ORDER BY work_ns) - 1 AS k, count(*) OVER (PARTITION BY profile, segment) AS n FROM a)
SELECT profile, segment, max(n) AS n, round(max(work_ns) FILTER (k = round(0.5 * (n - 1))) / 1000, 3) AS p50_us, round(max(work_ns) FILTER (k = round(0.99 * (n - 1))) / 1000, 3) AS p99_us, round(max(work_ns) FILTER (k = round(0.999 * (n - 1))) / 1000, 3) AS p999_us,
 round(min(work_ns) / 1000, 3) AS min_us, round(max(work_ns) / 1000, 3) AS max_us, round(avg(work_ns) / 1000, 3) AS mean_us FROM r GROUP BY profile, segment"""


@query(_SUMMARY.format(times=_TIMES))
def latency_summary(spark, d):
    """Latencies by profile and segment with a row ALL for each profile, percentiles by nearest rank, in microseconds."""
    return analytics.latency_summary(_times(spark, d), "work_ns", "profile", "segment")


@query(f"WITH t AS ({_TIMES}), m AS (SELECT profile, segment, CASE WHEN concurrency % 2 = 0 THEN 'disk' ELSE 'memory' END AS path, work_ns FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY profile, segment, path ORDER BY work_ns) - 1 AS k, count(*) OVER (PARTITION BY profile, segment, path) AS n FROM m), h AS (SELECT profile, segment, max(work_ns) FILTER (path = 'memory') AS a, max(work_ns) FILTER (path = 'disk') AS b FROM r WHERE k = round(0.5 * (n - 1)) GROUP BY profile, segment) SELECT profile, segment, round(a / 1e6, 3) AS memory_ms, round(b / 1e6, 3) AS disk_ms, round((b - a) / 1e6, 3) AS delta_ms FROM h")
def path_medians(spark, d):
    """Median time of two paths and their difference, in milliseconds."""
    rows = _times(spark, d).withColumn("path", F.when(F.col("concurrency") % 2 == 0, "disk").otherwise("memory"))
    return analytics.median_delta(rows, "work_ns", "path", ("memory", "disk"), "profile", "segment")


@query("SELECT l_linenumber AS n, count(*) FILTER (l_linestatus = 'O') AS placed, round(count(*) FILTER (l_linestatus = 'O') / greatest(sum(l_quantity), 1e-9), 6) AS rate, 2 * l_linenumber + 4 AS round_trips FROM lineitem GROUP BY l_linenumber")
def placement_throughput(spark, d):
    """Placements a second by number of workers, with the round trips that each takes."""
    rows = T.table(spark, d, "lineitem")
    by = rows.groupBy(F.col("l_linenumber").alias("n")).agg(F.count_if(F.col("l_linestatus") == "O").alias("placed"), F.sum("l_quantity").alias("elapsed"))
    return by.select("n", "placed", F.round(F.col("placed") / F.greatest("elapsed", F.lit(1e-9)), 6).alias("rate"), (2 * F.col("n") + 4).alias("round_trips"))


@query("WITH s AS (SELECT event_type AS queue, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT queue, count(*) AS samples, round(avg(value), 6) AS depth FROM s WHERE k >= n // 2 GROUP BY queue")
def steady_half(spark, d):
    """Mean depth of each queue over the later half of its samples."""
    series = T.table(spark, d, "events").select(F.col("event_type").alias("queue"), "event_id", F.col("value").alias("depth"))
    placed = in_order(series, "event_id", keys=["queue"])
    return exchange.steady_half(placed, "place", ["depth"], "queue").withColumn("depth", F.round("depth", 6))


@query("WITH v AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS ns FROM lineitem), b AS (SELECT ns, CASE WHEN ns < 2048 THEN 0 ELSE floor(log2(ns))::INT - 10 END AS shift FROM v) SELECT (ns >> shift) << shift AS low_ns, (((ns >> shift) + 1) << shift) - 1 AS high_ns, count(*) AS n FROM b GROUP BY ALL")
def latency_histogram(spark, d):
    """Counts in buckets of three significant figures: 11 leading bits; histograms of parts add up."""
    rows = T.table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("ns"))
    return analytics.histogram(rows, "ns")


@query("WITH r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT flag, max(v) AS median FROM r WHERE k = round(0.5 * (n - 1)) GROUP BY flag")
def repeated_medians(spark, d):
    """Medians of repeated measurements, by nearest rank."""
    rows = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    return analytics.nearest_rank(rows, "v", 0.5, "flag").select("flag", F.col("value").alias("median"))


_LATENCY = f"SELECT b - a AS latency_ns FROM (SELECT task, min(ts_ns) FILTER (event = 'signup') AS a, min(ts_ns) FILTER (event = 'purchase') AS b FROM ({T.LIFECYCLE}) GROUP BY task) WHERE a IS NOT NULL AND b >= a"


@query(f"SELECT 'signup-purchase' AS label, count(*) AS count, round(min(latency_ns) / 1000, 3) AS min_us, round(quantile_disc(latency_ns, 0.5) / 1000, 3) AS p50_us, round(quantile_disc(latency_ns, 0.99) / 1000, 3) AS p99_us, round(quantile_disc(latency_ns, 0.999) / 1000, 3) AS p999_us, round(max(latency_ns) / 1000, 3) AS max_us FROM ({_LATENCY})")
def percentile_rows(spark, d):
    """A stage's percentiles as a report row, in microseconds."""
    found = analytics.percentiles(analytics.stage_latency(T.derived(spark, d, T.LIFECYCLE_SPARK), "signup", "purchase"), "latency_ns")
    return sinks.percentile_row(found, "signup-purchase").drop("mean_us")
