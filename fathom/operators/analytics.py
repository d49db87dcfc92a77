"""Error rates, thresholds, fidelity, telemetry and placement over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .ordered import in_order

#: Fixed values of the similarity index.
C1, C2 = 6.5025, 58.5225


def error_rates(scores: DataFrame, threshold: Column, *keys: str) -> DataFrame:
    """Counts and rates of false accepts (attacks at or over the threshold) and false rejects; an empty class gives null."""
    count = lambda c: F.count_if(c).cast("bigint")
    attack, accepted = F.col("class") == "attack", F.col("score") >= threshold
    out = scores.groupBy(*keys).agg(count(attack).alias("attacks"), count(attack & accepted).alias("false_accepts"), count(~attack).alias("honest"), count(~attack & ~accepted).alias("false_rejects"))
    return out.withColumn("far", F.try_divide("false_accepts", "attacks")).withColumn("frr", F.try_divide("false_rejects", "honest"))


def candidate_thresholds(scores: DataFrame) -> DataFrame:
    """Below the least score, between neighbours, above the greatest; 0 without scores."""
    distinct = scores.select("score").distinct()
    placed = in_order(distinct, "score").where("previous is not null")
    between = placed.select(((F.col("score") + F.col("previous")) / 2).alias("threshold"))
    ends = F.when(F.min("score").isNull(), F.array(F.lit(0.0))).otherwise(F.array(F.min("score") - 1e-6, F.max("score") + 1e-6))
    return between.union(distinct.agg(ends.alias("t")).select(F.explode("t")))


def sweep(scores: DataFrame) -> DataFrame:
    """Rates at every candidate threshold by cumulative counts over the distinct scores."""
    by = scores.groupBy("score").agg(F.count_if(F.col("class") == "attack").alias("a"), F.count_if(F.col("class") != "attack").alias("h"))
    total = by.agg(F.sum("a").alias("attacks"), F.sum("h").alias("honest"), (F.max("score") + 1e-6).alias("threshold")).where("threshold is not null")
    placed = in_order(by, "score", sums={"ua": "a", "uh": "h"})
    rows = placed.select(F.coalesce((F.col("score") + F.col("previous")) / 2, F.col("score") - 1e-6).alias("threshold"), "ua", "uh").crossJoin(F.broadcast(total.select("attacks", "honest")))
    last = total.select("threshold", F.col("attacks").alias("ua"), F.col("honest").alias("uh"), "attacks", "honest")
    both = rows.union(last)
    return both.select("threshold", (F.col("attacks") - F.col("ua")).alias("false_accepts"), "attacks", F.col("uh").alias("false_rejects"), "honest", F.try_divide(F.col("attacks") - F.col("ua"), F.col("attacks")).alias("far"), F.try_divide("uh", "honest").alias("frr"))


def youden(swept: DataFrame) -> DataFrame:
    """The threshold with the greatest (1 - frr) - far, ties to the higher."""
    j = F.round(F.when(F.col("honest") > 0, 1 - F.col("frr")).otherwise(0.0) - F.coalesce("far", F.lit(0.0)), 9)
    return swept.withColumn("j", j).agg(F.max_by("threshold", F.struct("j", "threshold")).alias("threshold"), F.max("j").alias("j"))


def window_similarity(x: Column, y: Column) -> Column:
    """Similarity of two equally long arrays of pixels, with unbiased variances (0 of one pixel)."""
    n = F.size(x)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / n
    spread = lambda a, b: F.when(n > 1, F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e) / (n - 1)).otherwise(0.0)
    from_mean = lambda v, m: F.transform(v, lambda e: e - m)
    mx, my = mean(x), mean(y)
    dx, dy = from_mean(x, mx), from_mean(y, my)
    return ((2 * mx * my + C1) * (2 * spread(dx, dy) + C2)) / ((mx * mx + my * my + C1) * (spread(dx, dx) + spread(dy, dy) + C2))


#: Size and distance of the windows of the similarity index.
WINDOW, STRIDE = 8, 4


def windows_of(frames: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """A row per full window (wx, wy) of frames with w, h and aligned arrays a and b, with the window's pixels x and y; a smaller plane is one window.

    Only the window's rows are cut out of a plane, so no pixel has a row of its own.
    """
    starts = lambda n: F.expr(f"if({n} <= {size}, array(0), sequence(0, {n} - {size}, {stride}))")
    out = frames.withColumn("__w", F.explode(F.flatten(F.transform(starts("h"), lambda y: F.transform(starts("w"), lambda x: F.struct(y.alias("wy"), x.alias("wx")))))))
    rows = F.sequence(F.lit(0), F.least(F.col("h"), F.lit(size)) - 1)
    cut = lambda c: F.flatten(F.transform(rows, lambda r: F.slice(c, ((F.col("__w.wy") + r) * F.col("w") + F.col("__w.wx") + 1).cast("int"), F.least(F.col("w"), F.lit(size)).cast("int"))))
    return out.withColumns({"wx": F.col("__w.wx"), "wy": F.col("__w.wy"), "x": cut("a"), "y": cut("b")}).drop("a", "b", "__w")


def mean_similarity(frames: DataFrame, *keys: str) -> DataFrame:
    """Windows and their mean similarity per frame; planes of unequal size are refused."""
    fits = F.when((F.size("a") == F.col("w") * F.col("h")) & (F.size("b") == F.size("a")), F.col("a")).otherwise(F.raise_error(F.lit("planes of unequal size")))
    windows = windows_of(frames.withColumn("a", fits))
    return windows.groupBy(*keys).agg(F.count("*").alias("windows"), F.avg(window_similarity(F.col("x"), F.col("y"))).alias("mssim"))


def moments(x: Column, y: Column) -> Column:
    """Number, sums, sums of squares and sum of products of two aligned arrays of whole numbers; those of parts add up without error."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, e: a + e)
    product = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    return F.struct(F.size(x).cast("bigint").alias("n"), total(x).alias("x"), total(y).alias("y"), product(x, x).alias("xx"), product(y, y).alias("yy"), product(x, y).alias("xy"))


def similarity_of(m: Column) -> Column:
    """As window_similarity, of the moments of a window's pixels."""
    n = m["n"].cast("double")
    mx, my = m["x"] / n, m["y"] / n
    spread = lambda ab, a, b: F.when(m["n"] > 1, (m["n"] * m[ab] - m[a] * m[b]) / (n * (n - 1))).otherwise(0.0)
    return ((2 * mx * my + C1) * (2 * spread("xy", "x", "y") + C2)) / ((mx * mx + my * my + C1) * (spread("xx", "x", "x") + spread("yy", "y", "y") + C2))


def mosaic_similarity(parts: DataFrame, width: int, height: int, side: int, *keys: str, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Windows that hold pixels and their mean similarity, of planes given by pairs of square parts: keys, px, py (a part's corner) and whole pixels a and b.

    Parts are cut into tiles that no window splits; a window adds up its tiles'
    moments, so it is judged by the pixels there are, and a part paired more than
    once counts as often. Parts outside the plane count nowhere. A plane smaller than a window is one window.
    """
    starts = lambda n: range(0, n - size + 1, stride) if n > size else (0,)
    tile = math.gcd(side, size, stride)
    cut = lambda c, x, y: F.flatten(F.array(*(F.slice(c, (y + r) * side + x + 1, tile) for r in range(tile))))
    tiles = [F.struct((F.col("px") + x).alias("tx"), (F.col("py") + y).alias("ty"), moments(cut("a", x, y), cut("b", x, y)).alias("m")) for y in range(0, side, tile) for x in range(0, side, tile)]
    found = parts.select(*keys, F.array(*tiles).alias("tiles")).groupBy(*keys).agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for y in starts(height) for x in starts(width)))
    names = ("n", "x", "y", "xx", "yy", "xy")
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in names))
    inside = lambda t, w: (t["tx"] >= w["x"]) & (t["tx"] < w["x"] + size) & (t["ty"] >= w["y"]) & (t["ty"] < w["y"] + size)
    held = F.transform(corners, lambda w: F.aggregate(F.filter("tiles", lambda t: inside(t, w)), none, lambda m, t: F.struct(*((m[c] + t["m"][c]).alias(c) for c in names))))
    windows = F.transform(F.filter(held, lambda m: m["n"] > 0), similarity_of)
    scored = found.select(*keys, windows.alias("__s")).where("size(__s) > 0")
    return scored.select(*keys, F.size("__s").cast("bigint").alias("windows"), (F.aggregate("__s", F.lit(0.0), lambda a, e: a + e) / F.size("__s")).alias("mssim"))


def segment_verdicts(sent: DataFrame, blobs: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """(segment, detail, score): what each sent (segment, sent, output) is worth.

    First the blob (output, held) is looked up and its commitment compared, then
    the score decides; a missing blob, commitment or score is inconclusive.
    """
    joined = sent.join(blobs, "output", "left").join(scored, "segment", "left")
    bound = F.col("held") == F.col("sent")
    detail = F.when(bound.isNull(), "Inconclusive").when(~bound, "CommitmentMismatch").when(F.col("score").isNull(), "Inconclusive").when(F.col("score") >= threshold, "Ok").otherwise("FidelityBelowThreshold")
    return joined.select("segment", detail.alias("detail"), F.when(bound, F.col("score")).alias("score"))


def stage_latency(lifecycle: DataFrame, start: str, end: str) -> DataFrame:
    """Nanoseconds from a task's earliest start to its earliest end, where both exist in order."""
    first = lambda name: F.min(F.when(F.col("event") == name, F.col("ts_ns")))
    both = lifecycle.groupBy("task").agg(first(start).alias("a"), first(end).alias("b"))
    return both.where("a is not null and b >= a").select("task", (F.col("b") - F.col("a")).alias("latency_ns"))


#: Bits of a value that one pass of an order statistic tells apart.
DIGIT = 14


def discrete(values: DataFrame, wanted: Mapping[str, tuple[str, float]], *keys: str, aggregates: Sequence[Column] = (), digit: int = DIGIT) -> DataFrame:
    """keys, aggregates and, for each name and (column, q) of wanted, the least value that at least a share q of the column's values doesn't exceed.

    Columns are whole numbers; nulls count nowhere. Exact, by leading bits: a pass
    counts the values by their next bits within the bits that were found before,
    so no task holds more than 2**digit counts of a key, whatever the number of
    distinct values. For few keys: their bits are broadcast.
    """
    by, columns = [*keys, "__one"], sorted({c for c, _ in wanted.values()})
    rows = values.withColumn("__one", F.lit(0))
    ends = values.agg(*(f(c).cast("bigint").alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    plain = values.groupBy(*keys).agg(*aggregates, F.count("*").alias("__rows")).withColumn("__one", F.lit(0))
    spans = [(ends[f"lo{k}"], ends[f"hi{k}"]) for k in range(len(columns)) if ends[f"lo{k}"] is not None]
    if not spans:
        return plain.select("*", *(F.lit(None).cast("bigint").alias(n) for n in wanted)).drop("__one", "__rows")
    shift = next(s for s in range(64) if all((hi >> s) - (lo >> s) < 2**digit for lo, hi in spans))
    node = lambda v, s: F.call_function("shiftright", v, F.lit(s))
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("bigint").alias("v")) for k, c in enumerate(columns)))).alias("__x"))
    long = long.select(*by, F.col("__x.c").alias("__c"), F.col("__x.v").alias("__v")).where("__v is not null")
    upto = lambda *on: F.sum("__n").over(Window.partitionBy(*by, *on).orderBy("__node"))
    counted = long.groupBy(*by, "__c", node(F.col("__v"), shift).alias("__node")).agg(F.count("*").alias("__n")).withColumns({"__upto": upto("__c"), "__all": F.sum("__n").over(Window.partitionBy(*by, "__c"))})
    ranks = [F.struct(F.lit(k).alias("name"), F.lit(columns.index(c)).alias("c"), F.greatest(F.ceil(F.lit(Decimal(str(q))) * F.col("__all")).cast("bigint"), F.lit(1).cast("bigint")).alias("rank")) for k, (c, q) in enumerate(wanted.values())]
    counted = counted.withColumn("__w", F.explode(F.array(*ranks))).where("__w.c = __c").withColumns({"__name": F.col("__w.name"), "__rank": F.col("__w.rank")})
    while True:
        found = counted.where("__upto - __n < __rank and __rank <= __upto").select(*by, "__name", "__c", "__node", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
        if shift == 0:
            break
        low = max(0, shift - digit)
        within = scan.joined(long.withColumn("__node", node(F.col("__v"), shift)), F.broadcast(found), [*by, "__c", "__node"])
        counted = within.groupBy(*by, "__name", "__c", node(F.col("__v"), low).alias("__node")).agg(F.count("*").alias("__n"), F.first("__rank").alias("__rank")).withColumn("__upto", upto("__name"))
        shift = low
    found = found.groupBy(*by).agg(*(F.max(F.when(F.col("__name") == k, F.col("__node"))).alias(n) for k, n in enumerate(wanted)))
    return scan.joined(plain, F.broadcast(found), by, "left").drop("__one", "__rows")


def percentiles(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """Count, least, greatest, mean and discrete percentiles of a whole-number column, for few keys."""
    plain = [F.count("*").alias("count"), F.min(column).alias("min_ns"), F.max(column).alias("max_ns"), F.avg(column).alias("mean_ns")]
    found = discrete(values, {"p50": (column, 0.5), "p99": (column, 0.99), "p999": (column, 0.999)}, *keys, aggregates=plain)
    return found.select(*keys, "count", "min_ns", "p50", "p99", "p999", "max_ns", "mean_ns")


def nearest_rank(values: DataFrame, column: str, qs: float | list[float], *keys: str) -> DataFrame:
    """(keys, q, value): the value at place round(q * (n - 1)) of each key's sorted values, by places in ranges instead of one array."""
    counts = values.groupBy(*keys).agg(F.count("*").alias("n"))
    shares = F.array(*(F.lit(float(q)) for q in (qs if isinstance(qs, list) else [qs])))
    wanted = counts.withColumn("q", F.explode(shares)).withColumn("place", F.round(F.col("q") * (F.col("n") - 1)).cast("bigint"))
    placed = in_order(values.select(*keys, column), column, keys=keys)
    return placed.join(wanted, [*keys, "place"]).select(*keys, "q", F.col(column).alias("value"))


def latency_summary(values: DataFrame, column: str, profile: str, segment: str) -> DataFrame:
    """Count, nearest-rank percentiles, least, greatest and mean in microseconds, by profile and segment with a row ALL for each profile."""
    us = lambda c: F.round(F.col(c) / 1000, 3)
    both = values.select(profile, F.explode(F.array(F.col(segment), F.lit("ALL"))).alias(segment), column)
    shares = {"p50_us": 0.5, "p99_us": 0.99, "p999_us": 0.999}
    ranks = nearest_rank(both, column, list(shares.values()), profile, segment)
    ranks = ranks.groupBy(profile, segment).agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in shares.items()))
    plain = values.groupingSets([[profile, segment], [profile]], profile, segment).agg(F.count("*").alias("n"), F.min(column).alias("min_us"), F.max(column).alias("max_us"), F.avg(column).alias("mean_us"), F.grouping(segment).alias("whole"))
    plain = plain.withColumn(segment, F.when(F.col("whole") == 1, "ALL").otherwise(F.col(segment)))
    return plain.join(ranks, [profile, segment]).select(profile, segment, "n", *(us(c).alias(c) for c in (*shares, "min_us", "max_us", "mean_us")))


def median_delta(values: DataFrame, column: str, path: str, names: tuple[str, str], *keys: str) -> DataFrame:
    """Nearest-rank medians in milliseconds of two paths, and the second less the first."""
    medians = nearest_rank(values, column, 0.5, *keys, path)
    by = medians.groupBy(*keys).agg(*(F.max(F.when(F.col(path) == n, F.col("value"))).alias(n) for n in names))
    ms = lambda c: F.round(c / 1e6, 3)
    return by.select(*keys, *(ms(F.col(n)).alias(f"{n}_ms") for n in names), ms(F.col(names[1]) - F.col(names[0])).alias("delta_ms"))


def histogram(values: DataFrame, column: str, bits: int = 11) -> DataFrame:
    """(low, high, n) of the buckets that the leading ``bits`` bits of each value name; counts of parts add up."""
    v = F.col(column)
    shift = F.when(v < 2**bits, 0).otherwise(F.floor(F.log2(v)).cast("int") - (bits - 1))
    cut = values.select(v.alias("v"), shift.alias("s"))
    low = F.expr("shiftleft(shiftright(v, s), s)")
    high = F.expr("shiftleft(shiftright(v, s) + 1, s) - 1")
    return cut.groupBy(low.alias(f"low_{column}"), high.alias(f"high_{column}")).agg(F.count("*").alias("n"))


def back_fill(values: DataFrame, column: str, expected: int) -> DataFrame:
    """Each value v with v - e, v - 2e and so on down to e, to undo coordinated omission."""
    v = F.col(column)
    more = F.when(v >= 2 * expected, F.sequence(v - expected, F.lit(expected).cast("long"), F.lit(-expected).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return values.withColumn(column, F.explode(F.concat(F.array(v), more)))


def least_loaded(workers: DataFrame, now: int, window: int, cap: int) -> DataFrame:
    """The eligible worker with least in flight, then greatest average, then smallest id."""
    fit = workers.where(f"tier < 3 and in_flight < {cap} and greatest({now} - last_heartbeat, 0) <= {window}")
    return fit.agg(F.min_by("worker", F.struct("in_flight", -F.col("ewma"), "worker")).alias("worker"))
