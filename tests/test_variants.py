"""Forged segments against plain Python."""

from pyspark.sql import functions as F

from fathom.operators import variants


def test_pixels(spark):
    row = spark.createDataFrame([([0.0, 4.0, 8.0, 100.0, 104.0, 108.0, 63.0, 64.0, 255.0],)], "a array<double>").select(
        variants.downscaled(F.col("a"), 3, 3).alias("small"), variants.quantised(F.col("a"), 64).alias("coarse")
    ).first()
    assert list(row.small) == [52.0, 52.0, 58.0, 52.0, 52.0, 58.0, 63.5, 63.5, 255.0]
    assert list(row.coarse) == [32.0, 32.0, 32.0, 96.0, 96.0, 96.0, 32.0, 96.0, 224.0]


def test_samples_and_rates(spark):
    plane = lambda k: [float((7 * i * (k + 3) + 31 * k) % 256) for i in range(64)]
    rows = [(c, s, 10 * s + f, plane(5 * c + s + f), plane(90 + c) if c else None) for c in range(3) for s in range(4) for f in range(2)]
    frames = spark.createDataFrame(rows, "clip long, segment long, frame long, a array<double>, substitute array<double>")
    got = variants.samples(frames, 8, 8).collect()
    assert len(got) == 3 * 4 * 5 - 4
    assert all(r.set == ("held_out" if r.segment % 2 else "calibration") and (r["class"] == "honest") == (r.variant == "honest") for r in got)
    assert min(r.score for r in got if r.variant == "honest") > 0.99 > max(r.score for r in got if r.variant in ("garbage", "frame_substitution"))
    told = {r.variant: (r.n, r.accepted) for r in variants.rates(variants.samples(frames, 8, 8)).collect()}
    assert told["honest"] == (6, 6) and told["garbage"] == (6, 0) and told["frame_substitution"] == (4, 0)


def test_no_frames(spark):
    frames = spark.createDataFrame([], "clip long, segment long, frame long, a array<double>, substitute array<double>")
    assert variants.samples(frames, 8, 8).isEmpty() and variants.rates(variants.samples(frames, 8, 8)).isEmpty()
