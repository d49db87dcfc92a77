"""Queues between dispatcher, workers and verifiers as folders of JSON messages, and lease deadlines over a stream.

A push is a streaming sink partitioned by receiver, a pop a streaming source on
the receiver's part. Sources deliver at least once; what they feed is fenced by
epoch or keyed by address, so a repeat changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import exchange
from .tasks import START, advance, rejection

ASSIGNMENT = "task long, worker long, epoch long, deadline long"
REQUEST = "task long, output string, commitment string"
_STEP = "task long, seq long, event string, was string, status string, holder long, epoch long, deadline long, error string, actions string"
_STATE = "status string, holder long, epoch long, deadline long, epoch_hw long, retries long"


def push(messages: DataFrame, folder: str, checkpoint: str, receiver: str) -> DataStreamWriter:
    """A sink that appends messages to the inbox of each receiver; start it with a trigger."""
    kept = messages.withColumn("__to", F.col(receiver))
    return kept.writeStream.format("json").partitionBy("__to").option("checkpointLocation", checkpoint).option("path", folder)


def pop(spark: SparkSession, folder: str, receiver: int, schema: str = ASSIGNMENT, files_per_batch: int = 100) -> DataFrame:
    """The messages pushed to one receiver, as a stream; other inboxes aren't read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(f"{folder}/__to={receiver}")


def serve(lines: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict frames, undecodable lines) of verify requests that arrive as JSON lines (value).

    Each request's output is looked up in blobs (address, payload) and bound to
    its commitment: a missing one is inconclusive. A frame is tag 2 and a JSON body.
    """
    read = lines.select("value", F.from_json("value", REQUEST).alias("m"))
    good = F.coalesce(F.col("m.task").isNotNull() & F.col("m.output").isNotNull() & F.col("m.commitment").isNotNull(), F.lit(False))
    held = exchange.bound(blobs).select(F.col("address").alias("output"), F.col("commitment").alias("held"))
    asked = read.where(good).select("m.*").join(held, "output", "left")
    detail = F.when(F.col("held").isNull(), "Inconclusive").when(F.col("held") != F.col("commitment"), "CommitmentMismatch").otherwise("Ok")
    body = F.to_json(F.struct("task", (detail == "Ok").alias("passed"), detail.alias("detail")))
    return asked.select("task", F.lit(2).alias("tag"), body.alias("body")), read.where(~good).select("value")


def inbound(frames: DataFrame) -> DataFrame:
    """Return frames (tag, body) of a stream by kind; what can't be decoded is malformed and goes no further."""
    return exchange.route(frames.select("tag", "body"), F.col("tag"), F.col("body"))


def _expire(key: tuple, state: tuple) -> tuple[tuple, tuple]:
    """(row, state) of a lease whose deadline the clock has passed: back to pending, the epoch kept."""
    status, holder, epoch, deadline, epoch_hw, retries = state
    row = (key[0], None, "LeaseExpired", status, "Pending", holder, epoch, deadline, None, "Requeue,EmitReputation(Timeout)")
    return row, ("Pending", holder, epoch, deadline, epoch_hw, retries)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state, rows = (kept.get if kept.exists else START), []
    watermark = kept.getCurrentWatermarkMs()
    if state[0] == "Leased" and (kept.hasTimedOut or state[3] * 1000 <= watermark):
        row, state = _expire(key, state)
        rows.append(row)
    if not kept.hasTimedOut:
        for e in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
            error, was = rejection(state, e), state[0]
            if error is None:
                state = advance(state, e)
            rows.append((key[0], e.seq, e.event, was, *state[:4], error, ""))
    kept.update(tuple(None if v is None else v if isinstance(v, str) else int(v) for v in state))
    if state[0] == "Leased":
        kept.setTimeoutTimestamp(max(int(state[3]) * 1000, watermark + 1))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _STEP.split(", ")])
    yield out.astype({"seq": "Int64", "holder": "Int64"})


def with_deadlines(events: DataFrame) -> DataFrame:
    """A row per event of a stream and per lease that ran out.

    events has ``now``, the logical second of each event. The watermark on it is
    the reclaim clock: a lease whose deadline it reaches expires once, by a timer
    or before the task's next event, whichever comes first.
    """
    timed = events.withColumn("at", F.timestamp_seconds("now")).withWatermark("at", "0 seconds")
    wanted = timed.select("task", "seq", "event", "worker", "epoch", "deadline", "passed", "at")
    return wanted.groupBy("task").applyInPandasWithState(_fold, _STEP, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
