"""Points and the intervals that hold them, as an equi-join.

An interval of integers is the disjoint union of at most two aligned blocks of
each power of two; a point lies in one block of each. So intervals are cut into
their blocks, points are named by their block at each size that any interval
uses, and both meet by block: no pair is tried that doesn't hold, whatever the
lengths, and no bin width has to be chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(start: Column, end: Column) -> Column:
    """The aligned blocks (level, node) whose union is start..end-1: node * 2**level is a block's first number."""
    size = end - start
    levels = F.when(size > 0, F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") + 1)).otherwise(F.array().cast("array<int>"))

    def of(level: Column) -> Column:
        low = -F.call_function("shiftright", -start, level)
        high = F.call_function("shiftright", end, level)
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint")) == 1
        block = lambda node: F.struct(level.alias("level"), node.alias("node"))
        return F.array(F.when((low < high) & odd(low), block(low)), F.when((low < high) & odd(high), block(high - 1)))

    return F.filter(F.flatten(F.transform(levels, of)), lambda b: b.isNotNull())


def holding(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of a point and an interval of equal keys with start <= at < end, all integers; nulls and empty intervals pair with nothing.

    Columns of points, then those of intervals but keys. The sizes in use (64 at most) reach the driver.
    """
    whole = lambda c: F.col(c).cast("bigint")
    cut = intervals.withColumn("__b", F.explode(aligned(whole(start), whole(end)))).withColumn("__level", F.col("__b.level")).withColumn("__node", F.col("__b.node")).drop("__b")
    used = sorted(r[0] for r in cut.select("__level").distinct().collect())
    if not used:
        return points.limit(0).join(intervals.limit(0), list(keys)) if keys else points.limit(0).crossJoin(intervals.limit(0))
    spread = points.withColumn("__level", F.explode(F.array(*map(F.lit, used)))).withColumn("__node", F.call_function("shiftright", whole(at), F.col("__level")))
    return spread.join(cut, [*keys, "__level", "__node"]).drop("__level", "__node")
