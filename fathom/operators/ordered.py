"""Places, predecessors and running sums in one long order, without one task that sees all rows.

Rows are dealt to ranges of the leading column; a table of a row per range says
what the ranges before hold, and a window within each range adds the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
RANGE_ROWS = 100_000


def _tree(value: Column, cuts: Sequence, lo: int, hi: int) -> Column:
    """The number of the range of a value, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value <= F.lit(cuts[mid]), _tree(value, cuts, lo, mid)).otherwise(_tree(value, cuts, mid + 1, hi))


def in_order(rows: DataFrame, lead: str, *then: str, keys: Sequence[str] = (), sums: Mapping[str, str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with ``place`` (from 0) in the order of lead and then, within keys, and ``previous``, the lead value before.

    lead is a number without nulls. For each name and column of sums, the sum
    over all rows before. At most RANGES - 1 cut points reach the driver.
    """
    sums = dict(sums or {})
    shares = [k / RANGES for k in range(1, RANGES)]
    head = rows.agg(F.count("*").alias("n"), F.percentile_approx(lead, shares, 20 * RANGES).alias("cuts")).first()
    step = max(1, RANGES // max(1, -(-head.n // range_rows)))
    cuts = sorted(set((head.cuts or [])[step - 1 :: step]))
    dealt = rows.withColumn("__range", _tree(F.col(lead), cuts, 0, len(cuts)))
    by = [*keys, "__range"]
    held = dealt.groupBy(*by).agg(F.count("*").alias("__n"), F.max(lead).alias("__top"), *(F.sum(c).alias(f"__s{k}") for k, c in enumerate(sums.values())))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    held = held.select(*by, F.coalesce(F.sum("__n").over(earlier), none).alias("__n"), F.max("__top").over(earlier).alias("__top"), *(F.coalesce(F.sum(f"__s{k}").over(earlier), none).alias(f"__s{k}") for k in range(len(sums))))
    here = Window.partitionBy(*by).orderBy(lead, *then)
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    local = {"__k": F.row_number().over(here), "__p": F.lag(lead).over(here)} | {f"__l{k}": F.coalesce(F.sum(c).over(above), none) for k, c in enumerate(sums.values())}
    joined = dealt.withColumns(local).join(held, by)
    found = [(F.col("__k") - 1 + F.col("__n")).cast("bigint").alias("place"), F.coalesce("__p", "__top").alias("previous")]
    return joined.select(*rows.columns, *found, *((F.col(f"__l{k}") + F.col(f"__s{k}")).alias(name) for k, name in enumerate(sums)))
