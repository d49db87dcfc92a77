"""Ordered scans of associative values, and the last row before, over keys of any size.

Rows are dealt to ranges of (keys, order) by Spark's range partitioning, as many
as the rows need, so a key with a third of all rows spreads over many ranges and
so do rows that share their leading value. A range counts its rows; the counts
of the ranges before give every row its place. Places make blocks of BLOCK rows;
a block composes its values by doubling, and the blocks' composites are scanned
in the same way until a key has one block. No task and no row holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import store

#: Rows of a block, a power of two, and of a range, about.
BLOCK = 256
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Monoid:
    """combine(earlier, later) is associative, identity() its neutral element; both give columns of one type."""

    identity: Callable[[], Column]
    combine: Callable[[Column, Column], Column]


def joined(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b; null keys meet null keys."""
    named = b.withColumnsRenamed({c: f"__on_{c}" for c in on})
    return a.join(named, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on)), how).drop(*(f"__on_{c}" for c in on))


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """rows with ``__range``, a number that rises with (keys, order)."""
    if ranges < 2:
        return rows.withColumn("__range", F.lit(0))
    return store(rows.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _ranges(n: int, range_rows: int) -> int:
    return max(1, -(-n // range_rows))


def _sizes(rows: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """The number of rows, and that of the keys that have most."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return found.n or 0, found.most or 0


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """rows with ``place`` (from 0) in order within keys."""
    split = dealt(rows, keys, order, ranges)
    by = [*keys, "__range"]
    local = split.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint") - 1)
    if ranges < 2:
        return local.select(*rows.columns, F.col("__k").alias("place"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = split.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return joined(local, held, by).select(*rows.columns, (F.col("__k") + F.col("__n")).alias("place"))


def _doubled(values: Column, combine: Callable[[Column, Column], Column], reach: int) -> Column:
    """Each composite of reach values joined with the one of reach values before it."""
    return F.get(F.transform(F.array(values), lambda all_: F.transform(all_, lambda x, i: F.when(i >= reach, combine(F.get(all_, i - reach), x)).otherwise(x))), F.lit(0))


def _blocks(rows: DataFrame, keys: Sequence[str], carried: Sequence[str], monoid: Monoid, block: int) -> DataFrame:
    """keys, __block, log (place, __value and carried columns of its rows) and upto (the composite of each start of the log)."""
    by = [*keys, F.expr(f"place div {block}").alias("__block")]
    found = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "__value", F.struct(F.lit(0).alias("__none"), *carried).alias("row")))).alias("log"))
    upto, reach = F.transform("log", lambda r: r["__value"]), 1
    while reach < block:
        upto, reach = _doubled(upto, monoid.combine, reach), 2 * reach
    return found.withColumn("upto", upto)


def _scanned(rows: DataFrame, keys: Sequence[str], carried: Sequence[str], monoid: Monoid, block: int, most: int) -> DataFrame:
    """keys, carried, place, before and after of rows with place and __value; no keys have more than most."""
    blocks = _blocks(rows, keys, carried, monoid, block)
    if most > block:
        blocks = store(blocks, "blocks")
        heads = blocks.select(*keys, F.col("__block").alias("place"), F.element_at("upto", -1).alias("__value"))
        starts = _scanned(heads, keys, [], monoid, block, -(-most // block)).select(*keys, F.col("place").alias("__block"), F.col("before").alias("start"))
        blocks = joined(blocks, starts, [*keys, "__block"])
    else:
        blocks = blocks.withColumn("start", monoid.identity())
    opened = blocks.select(*keys, "start", "upto", F.posexplode("log").alias("__k", "__r"))
    before = F.when(F.col("__k") > 0, monoid.combine(F.col("start"), F.get("upto", F.col("__k") - 1))).otherwise(F.col("start"))
    after = monoid.combine(F.col("start"), F.get("upto", F.col("__k")))
    return opened.select(*keys, *(F.col(f"__r.row.{c}").alias(c) for c in carried), F.col("__r.place").alias("place"), before.alias("before"), after.alias("after"))


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, monoid: Monoid, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with place, before (the composite of the values of all earlier rows of the keys) and after (with the row's own)."""
    carried = [c for c in rows.columns if c not in keys]
    n, most = _sizes(rows, keys)
    made = placed(rows.withColumn("__value", value), keys, order, _ranges(n, range_rows))
    return _scanned(made, keys, carried, monoid, block, most).select(*rows.columns, "place", "before", "after")


def total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, monoid: Monoid, block: int = BLOCK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """keys, rows (their number) and value (the composite of all their values in order)."""
    n, most = _sizes(rows, keys)
    needed = list(dict.fromkeys([*keys, *order]))
    held = placed(rows.select(*needed, value.alias("__value")), keys, order, _ranges(n, range_rows)).select(*keys, "place", "__value", F.lit(1).cast("bigint").alias("rows"))
    while True:
        log = F.sort_array(F.collect_list(F.struct("place", "__value")))
        held = held.groupBy(*keys, F.expr(f"place div {block}").alias("place")).agg(log.alias("log"), F.sum("rows").alias("rows"))
        held = held.select(*keys, "place", "rows", F.aggregate("log", monoid.identity(), lambda a, r: monoid.combine(a, r["__value"])).alias("__value"))
        if most <= block:
            return held.select(*keys, "rows", F.col("__value").alias("value"))
        most = -(-most // block)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], ties: Sequence[str] = (), or_equal: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row of left with take of the last row of right of its keys whose at is less (or equal), else nulls.

    Of right rows of one at the greatest by ties, then by take, is the last. Rows
    whose at is null meet nothing; null keys meet null keys. Both sides are dealt
    to ranges of (keys, at); each range carries the last right row of those before.
    """
    kept = [c for c in left.columns if c not in (*keys, at)]
    values = list(dict.fromkeys([*ties, *take]))
    row, found = F.struct(F.lit(0).alias("__none"), *kept), F.struct(F.lit(0).alias("__none"), *values)
    a = left.select(*keys, at, F.lit(1 if or_equal else -1).alias("__side"), row.alias("__row"), F.lit(None).alias("__found"))
    b = right.where(F.col(at).isNotNull()).select(*keys, at, F.lit(0).alias("__side"), F.lit(None).alias("__row"), found.alias("__found"))
    order = [at, "__side", "__found"]
    both = a.unionByName(b)
    ranges = _ranges(both.count(), range_rows)
    split = dealt(both, keys, order, ranges)
    by = [*keys, "__range"]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = split.groupBy(*by).agg(F.max(F.when(F.col("__side") == 0, F.struct(*(F.col(c) for c in order)))).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(*by, F.last(F.col("__top.__found"), ignorenulls=True).over(earlier).alias("__carry"))
    local = split.withColumn("__near", F.last("__found", ignorenulls=True).over(before))
    carrying = (joined(local, carried, by) if ranges > 1 else local.withColumn("__carry", F.col("__near"))).where("__side <> 0")
    got = F.coalesce("__near", "__carry")
    named = {c: F.col(f"__row.{c}") for c in kept} | {c: F.col(c) for c in (*keys, at)}
    known = F.col(at).isNotNull()
    return carrying.select(*(named[c].alias(c) for c in left.columns), *(F.when(known, got[c]).alias(c) for c in take))
