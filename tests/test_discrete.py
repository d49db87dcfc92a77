"""Order statistics by leading bits against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import analytics
from fathom.plans import registry, summaries

from .conftest import DATA

WANTED = {"a50": ("a", 0.5), "a99": ("a", 0.99), "b50": ("b", 0.5), "b999": ("b", 0.999), "b0": ("b", 0.0), "b1": ("b", 1.0)}


def _least(values, thousandths):
    held = sorted(v for v in values if v is not None)
    return held[max(1, -(-thousandths * len(held) // 1000)) - 1] if held else None


@pytest.mark.parametrize("digit", [1, 3, 14])
def test_equal_to_sorting(spark, digit):
    """Negative and extreme values, ties, nulls, a null key, a key without values, and 100 values where 0.99 falls between neighbours."""
    draw = random.Random(5)
    rows = [("hundred", k, -k) for k in range(100)] + [("one", 7, -7), ("none", None, None), ("mixed", None, 4), ("tied", 3, 3), ("tied", 3, 3), ("tied", 9, 3)]
    rows += [(None, draw.randrange(-5000, 5000), draw.choice([-1, 0, 1, None])) for _ in range(301)]
    if digit == 14:
        rows += [("far", v, v // 2) for v in (-(2**63), 2**63 - 1, 0, 1, -1, 2**40, -(2**40))]
    found = analytics.discrete(spark.createDataFrame(rows, "key string, a long, b long"), WANTED, "key", aggregates=[F.count("*").alias("n")], digit=digit).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        of = {"a": [x[1] for x in rows if x[0] == r.key], "b": [x[2] for x in rows if x[0] == r.key]}
        assert r.n == len(of["a"])
        assert {n: r[n] for n in WANTED} == {n: _least(of[c], round(q * 1000)) for n, (c, q) in WANTED.items()}, r.key


def test_without_keys_and_without_rows(spark):
    rows = spark.range(1000).select(F.col("id").alias("v"))
    assert tuple(analytics.percentiles(rows, "v").first()) == (1000, 0, 499, 989, 998, 999, 499.5)
    assert [tuple(r) for r in analytics.percentiles(rows.limit(0), "v").collect()] == [(0, None, None, None, None, None, None)]
    assert analytics.discrete(rows.withColumn("k", F.lit(1)).limit(0), {"m": ("v", 0.5)}, "k").isEmpty()


@pytest.mark.parametrize("query", [summaries.verify_cost, summaries.crypto_share, summaries.percentile_rows, registry.stage_percentiles])
def test_no_task_holds_all_values_of_a_key(spark, query):
    assert "percentile" not in query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().lower()
