"""Timers of leases: streams over restarts against the batch fold; fences against the fold."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathom.operators import lifecycle
from fathom.plans import leases as queries
from fathom.sources import tables
from fathom.streaming import leases

from .conftest import DATA
from .test_streaming import _run, _source

SCHEMA = "task long, seq long, event string, worker long, epoch long, deadline long, passed boolean, now long, priority long"


@pytest.fixture()
def rocks(spark):
    leases.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _as_files(df, column, folder, parts):
    """Rows in order of column, dealt to one Parquet file per part, oldest first; nulls stay nulls."""
    rows = df.toArrow().sort_by(column)
    size = -(-len(rows) // parts)
    folder.mkdir()
    for k in range(parts):
        path = folder / f"{k}.parquet"
        pq.write_table(rows.slice(k * size, size), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    spark = rocks
    events = tables.derived(spark, DATA, queries.CLOCKED).where("task < 12").select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SCHEMA.split(", ")))
    folder = _as_files(events, "seq", tmp_path / "in", 4)
    for k in (2, 3):
        os.rename(f"{folder}/{k}.parquet", tmp_path / f"{k}.parquet")
    columns = [c.split(" ")[0] for c in leases.STEP.split(", ")]
    stream = lambda: leases.with_timers(_source(spark, folder, SCHEMA)).select(*columns)
    got = _run(stream(), tmp_path, "append")
    for k in (2, 3):
        os.rename(tmp_path / f"{k}.parquet", f"{folder}/{k}.parquet")
    got += _run(stream(), tmp_path, "append")
    want = lifecycle.clocked(events).collect()
    batch = sorted(((r.task, r.seq // 2, r.event, r.was, r.status, r.holder, r.epoch, r.deadline, r.error) for r in want if r.event != "Tick"), key=repr)
    assert sorted((r[1:10] for r in got if r[2] is not None), key=repr) == batch
    ended = sorted((r.task, r.epoch, r.deadline, r.priority) for r in lifecycle.reclaims(events).collect())
    assert sorted((r[1], r[7], r[8], r[10]) for r in got if r[2] is None) == ended and len({e[0] for e in ended}) > 3
    batches = [r[0] for r in got if r[2] is None]
    assert len(set(batches)) >= 3


def test_heartbeats_move_the_timer_and_three_leases_end_apart(rocks, tmp_path):
    """Task 1's lease has three deadlines, of which the last counts; task 2 loses three leases; task 3 submits in time; task 9 moves the clock."""
    rows = [
        (1, 1, "Lease", 5, 1, 20, None, 1, 4), (1, 2, "Heartbeat", 5, 1, 40, None, 10, None), (1, 3, "Heartbeat", 5, 1, 60, None, 30, None), (2, 4, "Lease", 6, 1, 35, None, 31, 2), (3, 5, "Lease", 7, 1, 50, None, 32, 1),
        (3, 6, "Submit", 7, 1, None, None, 45, None), (2, 7, "Lease", 6, 2, 55, None, 46, None), (9, 8, "Lease", 8, 1, 1000, None, 59, None), (2, 9, "Lease", 6, 3, 70, None, 60, None), (9, 10, "Heartbeat", 8, 1, 1000, None, 61, None),
        (1, 11, "Submit", 5, 1, None, None, 62, None), (9, 12, "Heartbeat", 8, 1, 1000, None, 70, None),
    ]
    events = rocks.createDataFrame(rows, SCHEMA)
    folder = _as_files(events, "seq", tmp_path / "in", 12)
    got = _run(leases.with_timers(_source(rocks, folder, SCHEMA)).select("task", "seq", "event", "epoch", "deadline", "error", "priority"), tmp_path, "append")
    assert sorted((r[1], r[4], r[5], r[7]) for r in got if r[2] is None) == [(1, 1, 60, 4), (2, 1, 35, 2), (2, 2, 55, 2), (2, 3, 70, 2)]
    assert [r[6] for r in got if r[1] == 1 and r[2] == 11] == ["IllegalTransition"]


def test_ended_tasks_are_forgotten(rocks, tmp_path):
    rows = [(1, 1, "Abandon", 5, 0, 0, None, 10, 3), (2, 2, "Lease", 5, 1, 900, None, 16, None), (2, 3, "Heartbeat", 5, 1, 900, None, 17, None), (1, 4, "Lease", 5, 1, 50, None, 20, None)]
    events = rocks.createDataFrame(rows, SCHEMA)
    for keep, error in ((5, None), (500, "Terminal")):
        folder = _as_files(events, "seq", tmp_path / f"in{keep}", 4)
        got = _run(leases.with_timers(_source(rocks, folder, SCHEMA), keep).select("task", "seq", "error"), tmp_path / f"c{keep}", "append")
        assert [r[3] for r in got if r[2] == 4] == [error]


def test_fences_agree_with_the_fold(spark):
    """With the leases that the fold granted, an as-of join finds the holder and epoch of every state."""
    events = tables.derived(spark, DATA, tables.TASK_EVENTS)
    steps = lifecycle.replay(events)
    granted = steps.where("event = 'Lease' and error is null").select("task", "seq", "holder", F.col("epoch").alias("current"))
    near = queries.fences(events.where("event in ('Heartbeat', 'Submit')").select("task", "seq", "worker", "epoch"), granted)
    both = near.join(steps.select("task", "seq", "was", F.col("holder").alias("h"), F.col("epoch").alias("e"), "error"), ["task", "seq"])
    assert both.where("not (holder <=> h) or coalesce(current, 0) <> e").isEmpty()
    leased = both.where("was = 'Leased'")
    assert leased.where("fence <> coalesce(error, 'Ok')").isEmpty() and leased.select("fence").distinct().count() >= 2


def test_reclaims_read_events_once_and_fold_them_once(spark, monkeypatch):
    """No job counts, deals or stores what the fold gives, and no filter evaluates it a second time."""
    from fathom.operators import scan

    monkeypatch.setattr(scan, "asof", lambda *a, **k: pytest.fail("the fold is read again"))
    events = tables.derived(spark, DATA, queries.CLOCKED)
    found = lifecycle.reclaims(events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("epoch_hw") and not [line for line in plan.split("\n") if "Filter" in line and "aggregate(" in line]
    assert plan.count("collect_list(") == 1
    rows = events.collect()
    want = [(r.task, r.seq, r.epoch, r.deadline, _brought(rows, r.task, r.seq)) for r in _ended(lifecycle.clocked(events).collect())]
    assert sorted(tuple(r) for r in found.select("task", "seq", "epoch", "deadline", "priority").collect()) == sorted(want) and len(want) > 10


def test_priority_is_the_last_brought_before_the_lease_ended(spark):
    """The second lease ends at an event that brings a priority itself, the third at the clock's end."""
    rows = [
        (1, 1, "Lease", 5, 1, 20, None, 1, 4), (1, 2, "Heartbeat", 9, 1, 20, None, 30, None), (1, 3, "Lease", 5, 2, 40, None, 31, None), (1, 4, "Submit", 9, 2, 40, None, 50, 7), (1, 5, "Lease", 5, 3, 60, None, 51, None),
        (2, 6, "Lease", 6, 1, 70, None, 52, None), (3, 7, "Lease", 6, 1, 900, None, 80, 1),
    ]
    got = lifecycle.reclaims(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, 20, 4), (1, 4, 2, 40, 7), (1, 8, 3, 60, 7), (2, 8, 1, 70, None)]


def _ended(steps):
    return [r.__class__(**r.asDict() | {"seq": r.seq // 2}) for r in steps if r.event == "Tick" and r.was == "Leased" and r.status == "Pending"]


def _brought(rows, task, seq):
    return max(((r.seq, r.priority) for r in rows if r.task == task and r.seq <= seq and r.priority is not None), default=(0, None))[1]
