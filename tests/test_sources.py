"""Logs, thresholds, keys, blobs and sinks as files."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import logs, sinks


def test_event_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("dispatched,7,123\n  intended , 4 , 9 \n\nonly,two\n,5,9\ndispatched,notanid,1\nx,1,2,3\n")
    (tmp_path / "b.log").write_text("accepted,7,500\n")
    (tmp_path / "c.txt").write_text("accepted,8,1\n")
    rows = {tuple(r) for r in logs.read_event_logs(spark, f"file://{tmp_path}").collect()}
    assert rows == {("dispatched", 7, 123), ("intended", 4, 9), ("accepted", 7, 500)}
    assert logs.read_event_logs(spark, f"file://{tmp_path}/none").isEmpty()


def test_threshold(spark, tmp_path):
    good, bad, broken = (tmp_path / f"{n}.json" for n in ("good", "bad", "broken"))
    good.write_text(json.dumps({"value": 0.932767, "provenance": "p", "more": [1]}))
    bad.write_text('{"provenance": "p"}')
    broken.write_text("{")
    assert tuple(logs.read_threshold(spark, f"file://{good}").first()) == (0.932767, "p")
    for path in (bad, broken, tmp_path / "missing.json"):
        with pytest.raises(Exception):  # noqa: B017 (each kind of refusal has its own class)
            logs.read_threshold(spark, f"file://{path}").collect()


def test_keys(spark, tmp_path):
    (tmp_path / "3-4.key").write_bytes(bytes(range(32)))
    (tmp_path / "x-4.key").write_bytes(b"skipped")
    assert [tuple(r) for r in logs.read_keys(spark, f"file://{tmp_path}").collect()] == [(3, 4, bytearray(range(32)))]
    (tmp_path / "5-6.key").write_bytes(b"short")
    with pytest.raises(Exception, match="32 bytes"):
        logs.read_keys(spark, f"file://{tmp_path}").collect()


def test_event_log_sink(spark, tmp_path):
    events = spark.createDataFrame([("intended", 1, 5)], "event string, task long, ts_ns long")
    path = f"file://{tmp_path}/x.log"
    for append in (False, True, True):
        sinks.write_event_log(events, path, append)
    assert spark.read.text(path).count() == 3
    sinks.write_event_log(events, path)
    assert [tuple(r) for r in logs.parse_events(spark.read.text(path)).collect()] == [("intended", 1, 5)]


def test_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "a,b")], "n int, t string"), f"file://{tmp_path}/deep/er")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/deep/er").collect()] == [("1", "a,b")]


def test_blobs_are_put_once(spark):
    payloads = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "payload binary")
    first = sinks.put_blobs(payloads, spark.createDataFrame([], "address string"))
    assert first.count() == 2 and sinks.put_blobs(payloads, first.where("payload = 'a'")).select(F.col("payload").cast("string")).collect() == [("b",)]


def test_percentile_row(spark):
    found = spark.createDataFrame([(3, 1500, 2000, 2500, 2501, 2502, 2000.4)], "count long, min_ns long, p50 long, p99 long, p999 long, max_ns long, mean_ns double")
    assert tuple(sinks.percentile_row(found, "x").first()) == ("x", 3, 1.5, 2.0, 2.5, 2.501, 2.502, 2.0)


def test_study(spark, tmp_path):
    """48 attacks of which 10 pass, 12 honest of which 1 fails, held out; four scores to calibrate by."""
    held = [("a", "held_out", k, "attack", 0.95 if k < 10 else 0.5) for k in range(48)] + [("b" if k else "a", "held_out", 100 + k, "honest", 0.9 if k == 3 else 0.99) for k in range(12)]
    calibration = [("a", "calibration", 200 + k, c, s) for k, (c, s) in enumerate([("honest", 0.97), ("honest", 0.98), ("attack", 0.1), ("attack", 0.55)])]
    sinks.write_study(f"file://{tmp_path}", spark.createDataFrame(held + calibration, "stratum string, part string, segment long, class string, score double"), 0.932767, "calibration", "held_out")
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"file://{tmp_path}/{name}").collect()
    assert [tuple(r) for r in read("held_out")] == [("FAR", 10, 48, 10 / 48, 0.104691, 0.34991), ("FRR", 1, 12, 1 / 12, 0.002108, 0.384796)]
    assert {r.stratum: (r.events, r.total) for r in read("strata")} == {"a": (0, 1), "b": (1, 11)}
    assert len(read("scores")) == 64 and len(read("calibration")) == 5
    assert logs.read_threshold(spark, f"file://{tmp_path}/threshold").first().value == 0.932767
