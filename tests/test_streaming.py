"""Streams must give what the batch operators give on the same rows, over batches and restarts."""

import json
import os

from fathom.operators import lifecycle
from fathom.sources import tables
from fathom.streaming import serving, tasks

from .conftest import DATA


def _as_files(df, column, folder, parts):
    """Rows in order of column, dealt to one Parquet file per part, oldest first."""
    rows = df.toPandas().sort_values(column)
    size = -(-len(rows) // parts)
    folder.mkdir()
    for k in range(parts):
        path = folder / f"{k}.parquet"
        rows.iloc[k * size : (k + 1) * size].to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def _run(stream, tmp_path, mode):
    out = []
    done = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).trigger(availableNow=True).start()
    done.awaitTermination()
    return out


def _source(spark, folder, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def test_replay_equals_batch(spark, tmp_path):
    events = tables.derived(spark, DATA, tables.TASK_EVENTS).where("task < 30")
    folder = _as_files(events, "seq", tmp_path / "in", 3)
    got = sorted(r[1:] for r in _run(tasks.replay(_source(spark, folder, events.schema)).select("task", "seq", "event", "was", "status", "holder", "epoch", "deadline", "epoch_hw", "retries", "error"), tmp_path, "append"))
    want = sorted(tuple(r) for r in lifecycle.replay(events).select("task", "seq", "event", "was", "status", "holder", "epoch", "deadline", "epoch_hw", "retries", "error").collect())
    assert got == want and len({r[8] for r in got}) > 1


def test_standings_equal_batch_after_a_restart(spark, tmp_path):
    verdicts = tables.derived(spark, DATA, tables.VERDICTS).where("worker < 40")
    folder = _as_files(verdicts, "seq", tmp_path / "in", 2)
    os.rename(f"{folder}/1.parquet", tmp_path / "later.parquet")
    first = _run(tasks.standings(_source(spark, folder, verdicts.schema)), tmp_path, "update")
    os.rename(tmp_path / "later.parquet", f"{folder}/1.parquet")
    second = _run(tasks.standings(_source(spark, folder, verdicts.schema)), tmp_path, "update")
    last = {r[1]: r[1:] for r in sorted(first + second)}
    assert sorted(last.values()) == sorted(tuple(r) for r in lifecycle.standings(verdicts).collect())


def test_inbox_keeps_broken_lines_apart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(json.dumps({"task": 1, "seq": 2, "event": "Lease", "worker": 3, "epoch": 1, "deadline": 9}) + "\nnot json\n{\"task\": \"x\"}\n")
    good, bad = tasks.inbox(spark, str(folder))
    assert [r[1:4] for r in _run(good, tmp_path / "g", "append")] == [(1, 2, "Lease")]
    assert sorted(r[1] for r in _run(bad, tmp_path / "b", "append")) == ["not json", '{"task": "x"}']


def test_release_once(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00'), ('a', timestamp '2024-01-01 00:00:05'), ('b', timestamp '2024-01-01 00:00:07') as t(output, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    got = _run(tasks.releases(_source(spark, str(tmp_path / "in"), rows.schema, 9)), tmp_path, "append")
    assert sorted(r[1] for r in got) == ["a", "b"]


def test_registry_keeps_the_latest(spark, tmp_path):
    spark.sql("select * from values (1L, 5L), (1L, 9L), (2L, 3L) as t(worker, now)").write.parquet(str(tmp_path / "in"))
    got = _run(tasks.registry(_source(spark, str(tmp_path / "in"), "worker long, now long", 9)), tmp_path, "complete")
    assert sorted(r[1:] for r in got if r[0] == max(g[0] for g in got)) == [(1, 9), (2, 3)]


def test_leases_run_out_by_the_clock(spark, tmp_path):
    """A timer ends task 1's lease after task 2's event moved the clock; task 3's own late event finds its lease ended."""
    rows = [(1, 1, "Lease", 5, 1, 100, False, 10), (3, 2, "Lease", 5, 1, 120, False, 11), (2, 3, "Lease", 6, 1, 900, False, 150), (3, 4, "Submit", 5, 1, 0, False, 160), (2, 5, "Heartbeat", 6, 1, 950, False, 170)]
    events = spark.createDataFrame(rows, serving_schema := "task long, seq long, event string, worker long, epoch long, deadline long, passed boolean, now long")
    folder = _as_files(events, "seq", tmp_path / "in", 5)
    got = [r[1:] for r in _run(serving.with_deadlines(_source(spark, folder, serving_schema)).select("task", "seq", "event", "was", "status", "error", "actions"), tmp_path, "append")]
    ended = [r for r in got if r[2] == "LeaseExpired"]
    assert sorted(ended) == [(1, None, "LeaseExpired", "Leased", "Pending", None, "Requeue,EmitReputation(Timeout)"), (3, None, "LeaseExpired", "Leased", "Pending", None, "Requeue,EmitReputation(Timeout)")]
    assert (3, 4, "Submit", "Pending", "Pending", "IllegalTransition", "") in got and (2, 5, "Heartbeat", "Leased", "Leased", None, "") in got


def test_messages_reach_their_receiver(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 1, 50), (2, 8, 1, 60), (3, 7, 2, 70)], serving.ASSIGNMENT)
    rows.write.parquet(str(tmp_path / "in"))
    done = serving.push(_source(spark, str(tmp_path / "in"), rows.schema, 9), str(tmp_path / "box"), str(tmp_path / "c1"), "worker").trigger(availableNow=True).start()
    done.awaitTermination()
    got = _run(serving.pop(spark, str(tmp_path / "box"), 7), tmp_path / "pop", "append")
    assert sorted(r[1:] for r in got) == [(1, 7, 1, 50), (3, 7, 2, 70)]


def test_requests_are_served_and_routed(spark, tmp_path):
    payload = bytearray(b"abc")
    blobs = spark.createDataFrame([("ba7816bf8f01cfea414140de5dae2223", payload)], "address string, payload binary")
    good = "8a7deab2cc5ee003b6394337538a52b3198f1a6ddeb10c7daf62fe1c9834b43b"
    lines = [json.dumps({"task": 1, "output": "ba7816bf8f01cfea414140de5dae2223", "commitment": good}), json.dumps({"task": 2, "output": "gone", "commitment": good}), json.dumps({"task": 3, "output": "ba7816bf8f01cfea414140de5dae2223", "commitment": "00"}), "nonsense"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    frames, broken = serving.serve(spark.readStream.text(str(tmp_path / "in")), blobs)
    sent = _run(frames, tmp_path / "f", "append")
    assert {(r[1], json.loads(r[3])["detail"]) for r in sent} == {(1, "Ok"), (2, "Inconclusive"), (3, "CommitmentMismatch")}
    assert [r[1] for r in _run(broken, tmp_path / "b", "append")] == ["nonsense"]
    spark.createDataFrame([(r[2], r[3]) for r in sent] + [(9, "{}"), (0, "")], "tag int, body string").write.parquet(str(tmp_path / "frames"))
    kinds = sorted(r[3] for r in _run(serving.inbound(_source(spark, str(tmp_path / "frames"), "tag int, body string", 9)), tmp_path / "r", "append"))
    assert kinds == ["malformed", "malformed", "verdict", "verdict", "verdict"]
