"""Registered queries of leases over time: fences by as-of joins, ticks by interval joins, reclaims by the clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, lifecycle, scan
from ..operators.ordered import in_order
from ..sources import tables as T
from .catalog import query
from .twins import fold


@query(f"""WITH e AS ({T.TASK_EVENTS}), l AS (SELECT task, seq, worker AS holder, epoch AS current FROM e WHERE event = 'Lease'), m AS (SELECT task, seq, event, worker, epoch FROM e WHERE event IN ('Heartbeat', 'Submit'))
SELECT m.task, m.seq, m.event, l.holder, l.current, CASE WHEN l.current IS NULL THEN 'IllegalTransition' WHEN m.epoch <> l.current THEN 'StaleEpoch' WHEN m.worker <> l.holder THEN 'WrongHolder' ELSE 'Ok' END AS fence
FROM m ASOF LEFT JOIN l ON m.task = l.task AND m.seq > l.seq""")
def lease_fences(spark, d):
    """The fence of each heartbeat and submission against the last lease before it."""
    events = T.derived(spark, d, T.TASK_EVENTS)
    granted = events.where("event = 'Lease'").select("task", "seq", F.col("worker").alias("holder"), F.col("epoch").alias("current"))
    return fences(events.where("event in ('Heartbeat', 'Submit')").select("task", "seq", "event", "worker", "epoch"), granted).drop("worker", "epoch")


def fences(messages, granted):
    """messages (task, seq, worker, epoch) with holder, current (epoch) and fence, by the last of granted (task, seq, holder, current) before each."""
    near = scan.asof(messages, granted, ["task"], "seq", ["holder", "current"], or_equal=False)
    fence = F.when(F.col("current").isNull(), "IllegalTransition").when(F.col("epoch") != F.col("current"), "StaleEpoch").when(F.col("worker") != F.col("holder"), "WrongHolder").otherwise("Ok")
    return near.withColumn("fence", fence)


_GRANTED = f"SELECT task, seq, seq + 40 + task * 7 % 90 AS due FROM ({T.TASK_EVENTS}) AS t WHERE event = 'Lease'"
_TICKS = "SELECT event_id AS tick FROM events WHERE event_type = 'error' AND value > 5"


@query(f"WITH l AS ({_GRANTED}), t AS ({_TICKS}) SELECT task, seq, due, tick FROM l ASOF LEFT JOIN t ON due <= tick")
def reclaim_ticks(spark, d):
    """The first tick of an irregular clock that finds each lease past its deadline; null where the clock stops before."""
    ticks = in_order(T.derived(spark, d, _TICKS), "tick").select("tick", F.coalesce(F.col("previous") + 1, F.lit(0)).alias("after"), (F.col("tick") + 1).alias("end"))
    granted = T.derived(spark, d, _GRANTED)
    found = intervals.holding(granted, ticks, "due", "after", "end").select("task", "seq", "tick")
    return granted.join(found, ["task", "seq"], "left").select("task", "seq", "due", "tick")


@query(f"WITH l AS ({_GRANTED}), t AS ({_TICKS}) SELECT task, seq, count(tick) AS ticks, min(tick) AS first_tick FROM l LEFT JOIN t ON tick >= seq AND tick < due GROUP BY ALL")
def ticks_in_lease(spark, d):
    """Ticks of the clock that each lease lives through."""
    granted = T.derived(spark, d, _GRANTED)
    held = intervals.holding(T.derived(spark, d, _TICKS), granted, "tick", "seq", "due").groupBy("task", "seq").agg(F.count("*").alias("ticks"), F.min("tick").alias("first_tick"))
    return granted.join(held, ["task", "seq"], "left").select("task", "seq", F.coalesce("ticks", F.lit(0)).alias("ticks"), "first_tick")


#: Task events whose seq is the clock as well, with the priority that a task's first event brings.
CLOCKED = f"SELECT task, seq, event, worker, epoch, seq + 50 + task % 50 AS deadline, passed, seq AS now, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY seq) = 1 THEN task * 7 % 5 END AS priority FROM ({T.TASK_EVENTS}) AS t"
_TICKED = f"""SELECT task, 2 * seq + 1 AS seq, event, worker, epoch, deadline, passed FROM ({CLOCKED}) AS a
 UNION ALL SELECT task, 2 * seq, 'Tick', NULL, NULL, now, NULL FROM ({CLOCKED}) AS b
 UNION ALL SELECT task, 2 * clock + 2, 'Tick', NULL, NULL, clock, NULL FROM (SELECT DISTINCT task FROM ({CLOCKED}) AS c) AS d, (SELECT max(event_id) AS clock FROM events) AS e"""


@query(f"""WITH RECURSIVE {fold(_TICKED)}, p AS (SELECT task, max(priority) AS priority FROM ({CLOCKED}) GROUP BY task)
SELECT f.task, epoch, deadline, priority FROM f JOIN p ON p.task = f.task WHERE event = 'Tick' AND error IS NULL AND rn > 0""")
def lease_reclaims(spark, d):
    """Every lease that the clock ended, to be queued again at the priority that its task came with."""
    events = T.derived(spark, d, CLOCKED)
    return lifecycle.reclaims(events).select("task", "epoch", "deadline", "priority")
