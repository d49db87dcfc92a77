"""What a worker may send for a segment, made from its reference frames, and one sample a segment and variant.

A clip's frames fall into windows of time; each window is a segment, of which a
few frames are compared. Segments of even number calibrate, odd ones are held out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analytics

#: Fixed names of the variants; only the first should pass.
HONEST, CHEAP_DOWNSCALE, WRONG_BITRATE, FRAME_SUBSTITUTION, GARBAGE = "honest", "cheap_downscale", "wrong_bitrate", "frame_substitution", "garbage"
BLACK = 16.0


def class_of(variant: Column) -> Column:
    return F.when(variant == HONEST, "honest").otherwise("attack")


def set_of(segment: Column) -> Column:
    return F.when(segment % 2 == 0, "calibration").otherwise("held_out")


def quantised(pixels: Column, step: int) -> Column:
    """Every pixel at the middle of its step."""
    return F.transform(pixels, lambda v: F.floor(v / step) * step + step / 2)


def downscaled(pixels: Column, width: int, height: int) -> Column:
    """Halved and doubled again: every pixel is the mean of its two by two; at an odd edge the last pixel counts twice."""

    def mean(k: Column) -> Column:
        x, y = F.floor(k % width / 2) * 2, F.floor(k / width / 2) * 2
        right, down = F.least(x + 1, F.lit(width - 1)), F.least(y + 1, F.lit(height - 1))
        at = lambda a, b: F.get(pixels, (b * width + a).cast("int"))
        return (at(x, y) + at(right, y) + at(x, down) + at(right, down)) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), mean)


def sent(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (a: reference, substitute: another clip's frame or null) with variant and b, a row per variant; no substitute, no such row."""
    pixels = F.col("a")
    made = {HONEST: quantised(pixels, 4), CHEAP_DOWNSCALE: downscaled(pixels, width, height), WRONG_BITRATE: quantised(pixels, 64), FRAME_SUBSTITUTION: F.col("substitute"), GARBAGE: F.transform(pixels, lambda _: F.lit(BLACK))}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("variant"), b.cast("array<double>").alias("b")) for name, b in made.items())))
    return frames.withColumn("__v", each).select("*", "__v.variant", "__v.b").drop("__v", "substitute").where("b is not null").withColumns({"w": F.lit(width), "h": F.lit(height)})


def samples(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(clip, segment, set, variant, class, score) of frames (clip, segment, frame, a, substitute): the least similarity of a segment's frames."""
    scored = analytics.mean_similarity(sent(frames, width, height), "clip", "segment", "frame", "variant")
    worst = scored.groupBy("clip", "segment", "variant").agg(F.min("mssim").alias("score"))
    return worst.select("clip", "segment", set_of(F.col("segment")).alias("set"), "variant", class_of(F.col("variant")).alias("class"), "score")


def rates(scored: DataFrame) -> DataFrame:
    """(variant, class, threshold, n, accepted, rate) of held-out samples, at the threshold that calibration gives."""
    calibration = scored.where(F.col("set") == "calibration").select("class", "score")
    best = analytics.youden(analytics.sweep(calibration)).select("threshold")
    held = scored.where(F.col("set") == "held_out").crossJoin(F.broadcast(best))  # one row
    out = held.groupBy("variant", "class", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).cast("bigint").alias("accepted"))
    return out.withColumn("rate", F.col("accepted") / F.col("n"))
