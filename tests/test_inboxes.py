"""The inbox source and sink: each message once, over killed writers, replayed batches and restarts."""

import os

from pyspark.sql import Row
from pyspark.sql.types import StructType

from fathom.sources import inboxes

from .test_leases import _as_files
from .test_streaming import _run, _source

SCHEMA = "task long, worker long, note string"


def _sent(stream, box, checkpoint, writer):
    done = stream.writeStream.format("inbox").option("path", str(box)).option("writer", writer).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    done.awaitTermination()


def _received(spark, box, tmp_path):
    return sorted(r[1:] for r in _run(spark.readStream.format("inbox").schema(SCHEMA).option("path", str(box)).load(), tmp_path, "append"))


def test_each_message_once(spark, tmp_path):
    inboxes.register(spark)
    rows = [(k, k % 3, f"n{k}\né" if k % 4 else None) for k in range(40)]
    folder = _as_files(spark.createDataFrame(rows, SCHEMA), "task", tmp_path / "in", 4)
    box, checkpoint = tmp_path / "box", tmp_path / "c"
    os.rename(f"{folder}/3.parquet", tmp_path / "3.parquet")
    _sent(_source(spark, folder, SCHEMA), box, checkpoint, "a")
    first = _received(spark, box, tmp_path / "r")
    assert first == sorted(rows[:30]) and len(os.listdir(box / "manifests")) == 3

    # The last batch is forgotten by the sink's checkpoint, as after a crash between the manifest and the checkpoint: it is written again.
    for name in ("2", ".2.crc"):
        os.remove(checkpoint / "commits" / name)
    _sent(_source(spark, folder, SCHEMA), box, checkpoint, "a")
    assert _received(spark, box, tmp_path / "r") == [] and len(os.listdir(box / "manifests")) == 3

    # A writer that dies before its manifest leaves a part that nobody reads; the batch is then written by the restarted query.
    lost = inboxes.InboxWriter(str(box), "a").write(iter([Row(task=30, worker=0, note="lost")]))
    assert lost.part and _received(spark, box, tmp_path / "r") == []
    os.rename(tmp_path / "3.parquet", f"{folder}/3.parquet")
    _sent(_source(spark, folder, SCHEMA), box, checkpoint, "a")
    assert _received(spark, box, tmp_path / "r") == sorted(rows[30:])


def test_two_writers_and_a_reader_from_the_start(spark, tmp_path):
    inboxes.register(spark)
    rows = [(k, 1, "x") for k in range(6)]
    folder = _as_files(spark.createDataFrame(rows, SCHEMA), "task", tmp_path / "in", 2)
    for writer in ("a", "b-1"):
        _sent(_source(spark, folder, SCHEMA), tmp_path / "box", tmp_path / writer, writer)
    assert _received(spark, tmp_path / "box", tmp_path / "r") == sorted(rows + rows)
    assert _received(spark, f"file://{tmp_path}/box", tmp_path / "other") == sorted(rows + rows)


def test_an_aborted_batch_leaves_nothing(tmp_path):
    writer = inboxes.InboxWriter(str(tmp_path), "a")
    written = [writer.write(iter([Row(task=1, worker=2, note=None)])), writer.write(iter([])), None]
    writer.abort(written, 0)
    assert os.listdir(tmp_path / "parts") == [] and inboxes.InboxReader(str(tmp_path), StructType([])).latestOffset() == {}
