"""Mixing sources to integer target weights by Pfair scheduling.

Blocks of ``size`` documents of a source are its subtasks. With share w of the
total weight, block j (from 0) is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); the earliest deadline among released blocks runs next. With
one block a slot and shares that add up to one, this keeps each source less than
one block from its ideal share at every slot.

The schedule repeats after as many slots as the weights sum to, so only that
table (at most ``MAX_TABLE`` slots, refused beyond) is made on the driver; each
document finds its slot from its rank within its source. Ranks are counted in
hash ranges of each source and shifted by the counts of the ranges before, so a
source that holds most rows is dealt over many tasks.

Slots follow the weights until a source has run out; ``balanced`` marks the
slots before the first such gap. No document is dropped or repeated.

Results for odd input: null is a source of its own; a null doc_id sorts first;
rows of one id are placed by a hash of all columns, and repeated rows take places
of their own; null or long texts play no part; a source without a weight is
refused; columns named as the results are replaced by them; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8
MAX_TABLE = 1_000_000
RANGE_ROWS = 20_000
RESULTS = ("block", "place", "release", "deadline", "slot", "balanced")


def schedule(weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, k, slot, release, deadline) of one period: each source's k-th block."""
    period = sum(weights.values())
    if period > MAX_TABLE or any(w < 1 for w in weights.values()):
        raise ValueError(f"weights must be positive and add up to at most {MAX_TABLE}")
    waiting = [(0, name, 0) for name in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[name]), name, k, release))
        deadline, name, k, release = heapq.heappop(ready)
        out.append((name, k, slot, release, deadline))
        if k + 1 < weights[name]:
            heapq.heappush(waiting, ((k + 1) * period // weights[name], name, k + 1))
    return out


def target_weight(source: str | None) -> int:
    """A stated target weight of a source: 1 to 4, by the last byte of its name; 1 without a name."""
    return 1 + (source.encode()[-1] % 4 if source else 0)


def target_weights(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    """The target weight of each source of docs, one more than mix takes at most."""
    names = docs.select(source_col).distinct().limit(MAX_TABLE + 1).collect()
    return {r[0]: target_weight(r[0]) for r in names}


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, size: int = BLOCK, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with block, release, deadline, slot, place (within the block) and balanced.

    Without weights, every source weighs 1.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    src = F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n"))
    named = docs.select("*", src.alias("__s"), key.alias("__h"), F.xxhash64(*docs.columns).alias("__row"))
    digits = 1
    sizes = named.groupBy("__s").agg(F.count("*").alias("n"))
    counts = {r["__s"]: r.n for r in sizes.limit(MAX_TABLE + 1).collect()}
    if weights is None:
        share = dict.fromkeys(counts, 1)
    else:
        share = {("n" if s is None else f"s{s}"): w for s, w in weights.items()}
        if missing := set(counts) - set(share):
            raise ValueError(f"no weight for {sorted(missing)[:5]}")
        share = {s: share[s] for s in counts}
    while max(counts.values(), default=0) / 16**digits > RANGE_ROWS:
        digits += 1
    named = named.withColumn("__r", F.substring("__h", 1, digits))
    ranges = named.groupBy("__s", "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__s", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__s", "__r").orderBy("__h", F.col(id_col), "__row"))
    ranked = named.withColumn("__k", local).join(ranges, ["__s", "__r"]).withColumn("__k", F.col("__k") + F.col("__before") - 1)
    ranked = ranked.withColumn("__b", F.expr(f"__k div {size}")).withColumn("__p", F.col("__k") % size)

    period = sum(share.values())
    period_table = schedule(share)
    slots = {(s, k): slot for s, k, slot, _, _ in period_table}
    table = spark.createDataFrame([(*row, share[row[0]]) for row in period_table], "__s string, __m long, __slot long, __r0 long, __d0 long, __w long")
    weight = spark.createDataFrame(list(share.items()), "__s string, __w long")
    ranked = ranked.join(F.broadcast(weight), "__s").withColumn("__m", F.col("__b") % F.col("__w")).withColumn("__turn", F.expr("__b div __w") * period).drop("__w")
    placed = ranked.join(F.broadcast(table), ["__s", "__m"])
    first_gap = min((n // size // share[s] * period + slots[s, n // size % share[s]] for s, n in counts.items()), default=0)
    slot = F.col("__turn") + F.col("__slot")
    found = (F.col("__b"), F.col("__p"), F.col("__turn") + F.col("__r0"), F.col("__turn") + F.col("__d0"), slot, slot < first_gap)
    return placed.select(*docs.columns, *(c.alias(name) for c, name in zip(found, RESULTS, strict=True)))
