"""Ordered scans, as-of joins and interval joins against plain loops, over keys and ties far larger than a range or block."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.functions import reputation
from fathom.operators import intervals, lifecycle, scan

LOCAL = {"block": 4, "range_rows": 50}


def _verdicts(spark, n=700):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice(list(reputation.VERDICT_DELTAS))) for k in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "worker long, seq long, detail string").repartition(5)


def test_clamped_scan_of_a_hot_key(spark):
    rows, df = _verdicts(spark)
    got = scan.scan(df, ["worker"], ["seq"], lifecycle.step(F.col("detail")), lifecycle.CLAMPED, **LOCAL)
    got = sorted(((r.worker or 0, r.seq, r.place, max(r.before.lo, min(r.before.hi, r.before.off)), max(r.after.lo, min(r.after.hi, r.after.off))) for r in got.collect()))
    want, now, place = [], {}, {}
    for w, k, detail in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        before = now.get(w, 0)
        now[w] = max(-128, min(0, before + reputation.VERDICT_DELTAS[detail]))
        want.append((w or 0, k, place.get(w, 0), before, now[w]))
        place[w] = place.get(w, 0) + 1
    assert got == want
    ends = scan.total(df, ["worker"], ["seq"], lifecycle.step(F.col("detail")), lifecycle.CLAMPED, **LOCAL).collect()
    assert {(r.worker, r.rows, max(r.value.lo, min(r.value.hi, r.value.off))) for r in ends} == {(w, place[w], now[w]) for w in now}


def test_a_hot_key_spreads_over_ranges(spark):
    """A third of all rows under one key, and all rows under one leading value: no range holds much more than its share."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("worker"), F.lit(1).alias("day"), F.col("id").alias("seq"))
    split = scan.dealt(df, ["worker"], ["day", "seq"], 30)
    by = [r["count"] for r in split.groupBy("__range").count().collect()]
    assert len(by) >= 25 and max(by) <= 400 and split.where("worker = 7").select("__range").distinct().count() >= 8
    assert scan.placed(df, [], ["day", "seq"], 30).where("place <> seq").isEmpty()


def test_affine_scan(spark):
    rng = random.Random(2)
    rows = [(k % 2, k, rng.random()) for k in range(300)]
    got = scan.total(spark.createDataFrame(rows, "key long, at long, x double"), ["key"], ["at"], lifecycle.ewma_step(F.col("x")), lifecycle.AFFINE, **LOCAL).collect()
    want = {}
    for key, _, x in rows:
        want[key] = 0.3 * x + 0.7 * want.get(key, 0.0)
    assert {r.key: round(r.value.add, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("or_equal", [True, False])
def test_asof(spark, or_equal):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 1, 2, None, 9]), rng.choice([None, *range(60)]), k) for k in range(400)]
    right = [(rng.choice([1, 2, None, 3]), rng.choice([None, *range(60)]), rng.randrange(1000)) for k in range(150)]
    a, b = spark.createDataFrame(left, "key long, at long, n long"), spark.createDataFrame(right, "key long, at long, value long")
    got = scan.asof(a, b, ["key"], "at", ["value"], or_equal=or_equal, range_rows=40)
    assert got.columns == ["key", "at", "n", "value"]
    want = []
    for key, at, n in left:
        fits = [(t, v) for k, t, v in right if k == key and at is not None and t is not None and (t < at or or_equal and t == at)]
        want.append((key, at, n, max(fits)[1] if fits else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert scan.asof(a, b.limit(0), ["key"], "at", ["value"]).where("value is not null").isEmpty() and scan.asof(a.limit(0), b, ["key"], "at", ["value"]).isEmpty()


def test_intervals(spark):
    rng = random.Random(4)
    points = [(k % 2, rng.randint(-70, 70)) for k in range(200)] + [(None, 3), (0, None)]
    spans = [(k % 2, s := rng.randint(-80, 60), s + rng.choice([0, 1, 5, 64, 100]), k) for k in range(60)] + [(0, 5, 1, 99), (1, None, 4, 98), (0, -(2**40), 2**40, 97)]
    a, b = spark.createDataFrame(points, "key long, at long"), spark.createDataFrame(spans, "key long, lo long, hi long, name long")
    got = intervals.holding(a, b, "at", "lo", "hi", ["key"])
    want = sorted((k, p, lo, hi, n) for k, p in points for j, lo, hi, n in spans if k == j and k is not None and p is not None and lo is not None and lo <= p < hi)
    assert sorted(tuple(r) for r in got.select("key", "at", "lo", "hi", "name").collect()) == want
    assert intervals.holding(a, b.where("hi < lo"), "at", "lo", "hi", ["key"]).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
