"""Queues, joined streams, upserts and observed counts over micro-batches and restarts."""

import heapq
import json
import os
import random
import time

from pyspark.sql import functions as F

from fathom.operators import lifecycle
from fathom.plans import flow
from fathom.plans import evidence, leases, registry  # noqa: F401 (each registers its queries)
from fathom.plans.catalog import QUERIES
from fathom.sources import tables, upserts
from fathom.streaming import metrics, queues, tasks

from .conftest import DATA
from .test_leases import _as_files, rocks  # noqa: F401
from .test_streaming import _run, _source


def _popped(rows):
    """Plain queues: what each pop gives."""
    waiting, known, out = {}, {}, []
    for queue, seq, op, task, priority, enqueued in sorted(rows, key=lambda r: r[1]):
        heap = waiting.setdefault(queue, [])
        if op == "pop":
            out.append((queue, seq, *((lambda x: (x[3], -x[0], x[1]))(heapq.heappop(heap)) if heap else (None, None, None))))
            continue
        if op == "push":
            known[queue, task] = priority or 0
        heapq.heappush(heap, (-known.get((queue, task), 0), enqueued, seq, task))
    return sorted(out, key=repr)


def test_pops_over_a_restart(rocks, tmp_path):  # noqa: F811
    rng = random.Random(9)
    rows = []
    for seq in range(240):
        op = rng.choice(["push", "push", "pop", "requeue"])
        rows.append((rng.choice(["gpu", "cpu"]), seq, op, None if op == "pop" else rng.randrange(30), rng.randrange(4) if op == "push" else None, None if op == "pop" else rng.randrange(50)))
    folder = _as_files(rocks.createDataFrame(rows, queues.COMMANDS), "seq", tmp_path / "in", 4)
    os.rename(f"{folder}/3.parquet", tmp_path / "3.parquet")
    columns = ["queue", "seq", "task", "priority", "enqueued"]
    got = _run(queues.pops(_source(rocks, folder, queues.COMMANDS)).select(*columns), tmp_path, "append")
    os.rename(tmp_path / "3.parquet", f"{folder}/3.parquet")
    got += _run(queues.pops(_source(rocks, folder, queues.COMMANDS)).select(*columns), tmp_path, "append")
    assert sorted((r[1:] for r in got), key=repr) == _popped(rows) and len({r[0] for r in got}) == 4


def test_pops_come_in_ready_order(rocks, tmp_path):  # noqa: F811
    ready = tables.derived(rocks, DATA, tables.READY_SPARK).where("task < 200")
    pushes = ready.select(F.lit("q").alias("queue"), "seq", F.lit("push").alias("op"), "task", "priority", "enqueued")
    last = pushes.agg(F.max("seq")).first()[0]
    n = pushes.count()
    asks = rocks.range(n).select(F.lit("q").alias("queue"), (F.col("id") + last + 1).alias("seq"), F.lit("pop").alias("op"), *(F.lit(None).cast("long").alias(c) for c in ("task", "priority", "enqueued")))
    folder = _as_files(pushes.unionByName(asks), "seq", tmp_path / "in", 3)
    got = [r[1] for r in sorted(_run(queues.pops(_source(rocks, folder, queues.COMMANDS)).select("task", "seq"), tmp_path, "append"), key=lambda r: r[2])]
    place = {r.task: (-r.priority, r.enqueued, r.task) for r in ready.collect()}
    assert got == sorted(place, key=place.get)


def test_joined_verdicts_feed_standings(spark, tmp_path):
    """Leases and verdicts as two streams, joined, written, and folded by a third, equal the batch standings after a restart."""
    events = tables.derived(spark, DATA, tables.TASK_EVENTS)
    steps = lifecycle.replay(events)
    leases = steps.where("event = 'Lease' and error is null").select("task", "epoch", "holder", F.timestamp_seconds("seq").alias("granted"), "seq")
    taken = flow.verdict_outcomes(spark, DATA).where("outcome in ('Accepted', 'Requeued', 'Failed')").select("task", "seq", F.expr(flow._DETAIL).alias("detail"))
    verdicts = taken.join(steps.select("task", "seq", "epoch"), ["task", "seq"]).select("task", "epoch", "seq", "detail", F.timestamp_seconds("seq").alias("at"))
    a, b = _as_files(leases, "seq", tmp_path / "leases", 3), _as_files(verdicts, "seq", tmp_path / "verdicts", 3)
    os.rename(f"{a}/2.parquet", tmp_path / "a2")
    os.rename(f"{b}/2.parquet", tmp_path / "b2")
    out, last = str(tmp_path / "joined"), {}
    for later in (False, True):
        if later:
            os.rename(tmp_path / "a2", f"{a}/2.parquet")
            os.rename(tmp_path / "b2", f"{b}/2.parquet")
        joined = queues.credited(_source(spark, b, verdicts.schema), _source(spark, a, leases.schema), "2 hours")
        done = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "j")).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
        for r in _run(tasks.standings(_source(spark, out, "worker long, seq long, detail string, at timestamp", 1000)), tmp_path / "s", "update"):
            last[r[1]] = r[1:]
    assert sorted(last.values()) == sorted(tuple(r) for r in QUERIES["verdict_standings"](spark, DATA).select("worker", "verdicts", "standing").collect())


def test_upserts_survive_replays_and_compaction(spark, tmp_path):
    folder, columns = str(tmp_path / "table"), "output string, task long, seq long"
    write = upserts.upsert(folder, ["output"], ["seq"])
    batches = [[("a", 1, 1), ("b", 1, 2), ("a", 2, 3)], [("a", 3, 4), ("c", 9, 5)], [("c", 8, 7), ("c", 7, 6)]]
    frames = [spark.createDataFrame(b, columns) for b in batches]
    held = lambda: sorted(tuple(r) for r in upserts.current(spark, folder, ["output"], columns).collect())
    for k, f in enumerate(frames):
        write(f, k)
    want = [("a", 3, 4), ("b", 1, 2), ("c", 8, 7)]
    assert held() == want
    for k in (2, 1, 2):
        write(frames[k], k)
    assert held() == want
    upserts.compact(spark, folder, ["output"], columns, 1)
    assert held() == want
    write(frames[2], 2)
    upserts.compact(spark, folder, ["output"], columns, 2)
    write(spark.createDataFrame([("b", 5, 9)], columns), 3)
    assert held() == [("a", 3, 4), ("b", 5, 9), ("c", 8, 7)]


def test_releases_as_an_upsert_stream(spark, tmp_path):
    rows = tables.table(spark, DATA, "documents").select(F.substring(F.sha2("text", 256), 1, 32).alias("output"), F.col("doc_id").alias("task"), "lang")
    folder = _as_files(rows, "task", tmp_path / "in", 4)
    stream = _source(spark, folder, rows.schema).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(upserts.upsert(str(tmp_path / "t"), ["output"], ["task"])).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = upserts.current(spark, str(tmp_path / "t"), ["output"], "output string, task long, lang string").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in QUERIES["last_releases"](spark, DATA).select("output", "task", "lang").collect())


def test_observed_counts_reach_the_log(spark, tmp_path):
    rows = tables.derived(spark, DATA, tables.TASK_EVENTS).where("task < 8").select("task", "seq", "event")
    folder = _as_files(rows, "seq", tmp_path / "in", 3)
    log = metrics.EventLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        counted = metrics.observed(_source(spark, folder, rows.schema), "events", leases=F.col("event") == "Lease")
        stream = counted.writeStream.queryName("intake").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        stream.awaitTermination()
        for _ in range(60):
            if os.path.isdir(tmp_path / "log") and metrics.read_log(spark, str(tmp_path / "log")).count() == 3:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    got = {r.batch: r.counts for r in metrics.read_log(spark, str(tmp_path / "log")).collect()}
    events = [r.event for r in rows.orderBy("seq").collect()]
    size = -(-len(events) // 3)
    assert got == {k: {"rows": len(p), "leases": p.count("Lease")} for k in range(3) for p in [events[k * size : (k + 1) * size]]}
    metrics.EventLog(spark, None).record("q", 1, {"m": {"rows": 1}})
    assert json.loads(json.dumps(got))
