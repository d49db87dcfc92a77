"""Frames cut by offset out of binary planes, sampled at challenge positions and scored against a reference.

A segment's decoded frames are one binary: frame after frame of w * h bytes. A
binary that is empty or no multiple of that is refused as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import analytics

FRAME_SIZE = "FrameSize"


def packed(pixels: Column) -> Column:
    """An array of numbers from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def frame_count(planes: Column, width: int, height: int) -> Column:
    """How many frames there are; null where the bytes don't divide into frames."""
    size = width * height
    return F.when((F.length(planes) > 0) & (F.length(planes) % size == 0), (F.length(planes) / size).cast("int"))


def pixels_at(planes: Column, index: Column, width: int, height: int) -> Column:
    """The pixels of one frame."""
    size = width * height
    digits = F.hex(F.substring(planes, index.cast("int") * size + 1, F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("double"))


def sampled_scores(segments: DataFrame, width: int, height: int) -> DataFrame:
    """(segment, frames, error, worst) of segments (segment, sent, reference, fractions): the least similarity of sampled frames.

    Both binaries are cut at the same fractions of their own length, and the
    k-th cut of one meets the k-th of the other. Either binary refused, or no
    fraction given, is an error and has no score.
    """
    counted = segments.withColumn("frames", frame_count(F.col("sent"), width, height)).withColumn("held", frame_count(F.col("reference"), width, height))
    whole = F.col("frames").isNotNull() & F.col("held").isNotNull() & (F.size("fractions") > 0)
    cuts = counted.where(whole).select("segment", "sent", "reference", "frames", "held", F.posexplode("fractions").alias("k", "fraction"))
    cuts = cuts.select("segment", "k", *(pixels_at(F.col(c), scalars.frame_index(F.col("fraction"), F.col(n)), width, height).alias(x) for c, n, x in (("sent", "frames", "a"), ("reference", "held", "b"))), F.lit(width).alias("w"), F.lit(height).alias("h"))
    worst = analytics.mean_similarity(cuts, "segment", "k").groupBy("segment").agg(F.min("mssim").alias("worst"))
    return counted.select("segment", "frames", F.when(~F.coalesce(whole, F.lit(False)), FRAME_SIZE).alias("error")).join(worst, "segment", "left")


def flipped(payload: Column, place: Column) -> Column:
    """payload with all bits of the byte at place (from 0) turned; an empty one stays."""
    at = place.cast("int")
    byte = F.conv(F.hex(F.substring(payload, at + 1, F.lit(1))), 16, 10).cast("int")
    turned = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(255))), 2, "0"))
    return F.when(F.length(payload) == 0, payload).otherwise(F.concat(F.substring(payload, F.lit(1), at), turned, F.substring(payload, at + 2, F.length(payload))))
