"""Sequential policies: admission, greedy dispatch and escalation.

Each is sequential within a queue or a seed only; groups are queues, shards of
workers or seeds and run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import reputation, scalars

TICK, CAP, DRAIN = 20, 16, 3


def admission(arrivals: DataFrame, tick: int = TICK, cap: int = CAP, drain: int = DRAIN) -> DataFrame:
    """Per queue (event_type) and tick: offered, admitted, shed and depth. The fold runs over ticks, not arrivals."""
    by = arrivals.groupBy("event_type", F.expr(f"event_id div {tick}").alias("tick")).agg(F.count("*").alias("offered"))
    logs = by.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("tick", "offered"))).alias("log"))
    start = "named_struct('tick', -1L, 'offered', 0L, 'admitted', 0L, 'shed', 0L, 'depth', 0L)"
    left = f"greatest(0L, p.depth - {drain} * (e.tick - p.tick))"
    step = f"named_struct('tick', e.tick, 'offered', e.offered, 'admitted', least(e.offered, {cap} - {left}), 'shed', e.offered - least(e.offered, {cap} - {left}), 'depth', {left} + least(e.offered, {cap} - {left}))"
    fold = f"aggregate(log, array({start}), (acc, e) -> concat(acc, transform(array(element_at(acc, -1)), p -> {step})))"
    return logs.select("event_type", F.expr(f"inline(slice({fold}, 2, size(log)))"))


def saturation_summary(ticks: DataFrame) -> DataFrame:
    total = ticks.groupBy("event_type").agg(F.sum("offered").alias("offered"), F.sum("admitted").alias("admitted"), F.sum("shed").alias("shed"), F.max("depth").alias("max_depth"))
    return total.withColumn("shed_pct", F.round(100 * F.col("shed") / F.greatest("offered", F.lit(1)), 3))


def dispatch(ready: DataFrame, workers: DataFrame, cap: int, now: int, window: int) -> DataFrame:
    """Greedy placement in rounds, the same as task by task to the least loaded worker.

    Worker slots sorted by (in flight after placement, average, id) and tasks
    sorted by urgency are matched rank by rank; both sides are bounded by the
    free slots of the eligible workers.
    """
    fit = workers.where(f"tier < 3 and in_flight < {cap} and greatest({now} - last_heartbeat, 0) <= {window}")
    slots = fit.withColumn("load", F.explode(F.sequence(F.col("in_flight"), F.lit(cap - 1).cast("bigint"))))
    slots = slots.select("worker", F.row_number().over(_order("load", F.desc("ewma"), "worker")).alias("place"))
    free = slots.count()
    tasks = ready.orderBy(F.desc("priority"), "enqueued", "seq").limit(free)
    tasks = tasks.select("task", "priority", F.row_number().over(_order(F.desc("priority"), "enqueued", "seq")).alias("place"))
    return tasks.join(slots, "place").select("place", "task", "priority", "worker")


def _order(*columns: object) -> WindowSpec:


    return Window.orderBy(*columns)


def _one_seed(batches: Iterator[pd.DataFrame], jobs: int, hit: dict[int, float]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for seed, draws in zip(batch.seed, batch.draws, strict=True):
            standing = 0
            for job in range(jobs):
                tier = next((k for k, edge in enumerate(reputation.TIER_EDGES) if standing >= edge), len(reputation.TIER_EDGES))
                if tier == 4:
                    break
                caught = bool(draws[job] < hit[tier])
                after = max(reputation.FLOOR, min(0, standing + (-8 if caught else 1)))
                rows.append((seed, job + 1, tier, caught, after))
                standing = after
        yield pd.DataFrame(rows, columns=["seed", "job", "tier", "caught", "standing"])


def escalation(spark: SparkSession, seeds: int, jobs: int, share: float, slots: int) -> DataFrame:
    """(seed, job, tier, caught, standing): jobs of a worker that cheats in a share of its slots, until banned or done."""
    tiers = spark.createDataFrame([(k, float(p)) for k, p in enumerate(reputation.TIER_SHARES)], "tier int, p double")
    m = F.lit(int(-(-share * slots // 1))).cast("bigint")
    caught = scalars.detect_hypergeometric(F.lit(slots).cast("bigint"), m, reputation.challenge_count(F.col("p"), F.lit(slots).cast("bigint")))
    hit = {r.tier: r.c for r in tiers.select("tier", caught.alias("c")).collect()}
    key = lambda j: F.concat(F.lit("esc:"), F.col("id").cast("string"), F.lit(":"), j.cast("string")).cast("binary")
    draws = spark.range(seeds).select(F.col("id").alias("seed"), F.transform(F.sequence(F.lit(1), F.lit(jobs)), lambda j: scalars.uniform(key(j))).alias("draws"))
    return draws.mapInPandas(lambda b: _one_seed(b, jobs, hit), "seed long, job int, tier int, caught boolean, standing int")


def escalation_summary(rows: DataFrame) -> DataFrame:
    """Mean jobs to the first catch and to the ban, over the seeds that got there."""
    by = rows.groupBy("seed").agg(F.min(F.when(F.col("caught"), F.col("job"))).alias("catch"), F.min(F.when(F.col("standing") <= -64, F.col("job"))).alias("ban"))
    return by.agg(F.count("*").alias("seeds"), F.round(F.avg("catch"), 6).alias("mean_first_catch"), F.round(F.avg("ban"), 6).alias("mean_ban"))
