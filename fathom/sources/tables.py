"""Domain tables derived from the stored ones, stated once as SQL that any engine reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")

#: Lifecycle events of tasks: a lease opens the next epoch; some rows carry a stale epoch or another worker.
TASK_EVENTS = """
SELECT user_id AS task, event_id AS seq,
 CASE event_type WHEN 'signup' THEN 'Lease' WHEN 'purchase' THEN 'Submit' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'Heartbeat' ELSE 'SelectForVerification' END
  WHEN 'click' THEN CASE WHEN k % 7 = 0 THEN 'Accept' ELSE 'SelectForVerification' END
  ELSE CASE WHEN k = 98 THEN 'Abandon' WHEN k % 2 = 0 THEN 'VerifyOutcome' ELSE 'LeaseExpired' END END AS event,
 1 + leases % 2 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS worker,
 leases - CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS epoch, event_id + 10 AS deadline, k % 3 = 0 AS passed
FROM (SELECT user_id, event_id, event_type, k, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS leases
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) AS a) AS b"""
VERDICTS = """
SELECT user_id AS worker, event_id AS seq,
 CASE event_type WHEN 'error' THEN CASE WHEN value > 20 THEN 'CommitmentMismatch' WHEN value > 10 THEN 'IntegrityViolation' ELSE 'FidelityBelowThreshold' END WHEN 'signup' THEN 'Inconclusive' ELSE 'Ok' END AS detail
FROM events"""
LIFECYCLE = "SELECT event_type AS event, user_id AS task, CAST(EXTRACT(EPOCH FROM ts) * 1000000 AS BIGINT) * 1000 AS ts_ns FROM events"
LIFECYCLE_SPARK = "SELECT event_type AS event, user_id AS task, timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 1000 AS ts_ns FROM events"
READY = "SELECT o_orderkey AS task, 5 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS enqueued, o_orderkey AS seq FROM orders"
READY_SPARK = "SELECT o_orderkey AS task, 5 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1990-01-01') AS BIGINT) AS enqueued, o_orderkey AS seq FROM orders"
WORKERS = """
SELECT s_suppkey AS worker, CAST(count(l_orderkey) % 7 AS BIGINT) AS in_flight, coalesce(max(l_quantity), 0) AS ewma, CAST(count(l_orderkey) % 50 AS BIGINT) AS last_heartbeat, CAST(s_suppkey % 5 AS INT) AS tier
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus = 'O' GROUP BY s_suppkey"""
SCORES = """
SELECT lang AS stratum, CASE WHEN d.doc_id % 2 = 0 THEN 'calibration' ELSE 'held_out' END AS part, d.doc_id AS segment, CASE WHEN toxic = 1 THEN 'attack' ELSE 'honest' END AS class,
 CAST(CASE WHEN toxic = 1 THEN (n_chars % 83) / 100.0 ELSE (17 + n_chars % 83) / 100.0 END AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derived table; the stored tables that its text reads are handed over as DataFrames, no view is made."""
    named = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
    frames = {m.group(2): table(spark, sf_dir, m.group(2)) for m in named.finditer(text)}
    return spark.sql(named.sub(r"\1 {\2}", text), **frames)
