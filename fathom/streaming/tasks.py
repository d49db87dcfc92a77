"""Task lifecycle, standings, releases and the worker registry over streams.

State is one small row per key in Spark's state store, so it follows the number
of keys and survives lost executors by the query's checkpoint. Within a
micro-batch the rows of a key are folded in order of seq; what a batch and its
predecessors hold is folded as the batch operators fold one whole log. Late rows
are decided by epoch, not by time: a superseded epoch is a rejection row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import reputation
from ..plans.rules import MAX_RETRIES

EVENT_SCHEMA = "task long, seq long, event string, worker long, epoch long, deadline long, passed boolean"
_STATE = "status string, holder long, epoch long, deadline long, epoch_hw long, retries long"
_STEP = f"task long, seq long, event string, was string, {_STATE}, error string"
START = ("Pending", None, 0, 0, 0, 0)
#: The status in which an event is legal. Fixed values.
LEGAL_IN = {"Lease": "Pending", "Heartbeat": "Leased", "Submit": "Leased", "SelectForVerification": "Submitted", "Accept": "Submitted", "VerifyOutcome": "Verifying", "LeaseExpired": "Leased"}


def rejection(state: tuple, event: Any) -> str | None:
    """Why the event leaves the state as it is, else None."""
    status, holder, epoch, _, epoch_hw, _ = state
    if status in ("Accepted", "Failed"):
        return "Terminal"
    if event.event == "Abandon" or event.event == "LeaseExpired" and status == "Submitted":
        return None
    if LEGAL_IN.get(event.event) != status:
        return "IllegalTransition"
    if event.event == "Lease":
        return "StaleEpoch" if event.epoch <= epoch_hw else None
    if event.event in ("Heartbeat", "Submit", "LeaseExpired") and event.epoch != epoch:
        return "StaleEpoch"
    return "WrongHolder" if event.event in ("Heartbeat", "Submit") and event.worker != holder else None


def advance(state: tuple, event: Any) -> tuple:
    """The state after an event that isn't rejected."""
    status, holder, epoch, deadline, epoch_hw, retries = state
    match event.event:
        case "Lease":
            return "Leased", event.worker, event.epoch, event.deadline, event.epoch, retries
        case "Heartbeat":
            return status, holder, epoch, event.deadline, epoch_hw, retries
        case "VerifyOutcome" if not event.passed:
            again = retries < MAX_RETRIES
            return "Pending" if again else "Failed", holder, epoch, deadline, epoch_hw, retries + again
        case "LeaseExpired":
            return "Pending" if status == "Leased" else status, holder, epoch, deadline, epoch_hw, retries
    after = {"Abandon": "Failed", "Submit": "Submitted", "SelectForVerification": "Verifying", "Accept": "Accepted", "VerifyOutcome": "Accepted"}
    return after[event.event], holder, epoch, deadline, epoch_hw, retries


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def _fold_task(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state, rows = (kept.get if kept.exists else START), []
    for e in _ordered(frames).itertuples(index=False):
        error, was = rejection(state, e), state[0]
        if error is None:
            state = advance(state, e)
        rows.append((key[0], e.seq, e.event, was, *state, error))
    kept.update(tuple(None if v is None else v if isinstance(v, str) else int(v) for v in state))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _STEP.split(", ")])
    yield out.astype({"holder": "Int64"})


def replay(events: DataFrame) -> DataFrame:
    """A row per event of a stream: status before, state after, and the error of a rejected one."""
    wanted = events.select(*(c.split()[0] for c in EVENT_SCHEMA.split(", ")))
    return wanted.groupBy("task").applyInPandasWithState(_fold_task, _STEP, _STATE, "append", GroupStateTimeout.NoTimeout)


def _fold_standing(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    count, standing = kept.get if kept.exists else (0, 0)
    for e in _ordered(frames).itertuples(index=False):
        standing = max(reputation.FLOOR, min(0, standing + reputation.VERDICT_DELTAS[e.detail]))
        count += 1
    kept.update((count, standing))
    yield pd.DataFrame([(key[0], count, standing)], columns=["worker", "verdicts", "standing"])


def standings(verdicts: DataFrame) -> DataFrame:
    """(worker, verdicts, standing) of each worker with news, from a stream (worker, seq, detail)."""
    return verdicts.select("worker", "seq", "detail").groupBy("worker").applyInPandasWithState(_fold_standing, "worker long, verdicts long, standing int", "verdicts long, standing int", "update", GroupStateTimeout.NoTimeout)


def registry(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of each worker seen in a stream (worker, now)."""
    return heartbeats.groupBy("worker").agg(F.max("now").alias("last_heartbeat"))


def releases(accepted: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each output address; a repeat within the delay of event time ``ts`` is dropped and its state then freed."""
    return accepted.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["output"])


def inbox(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, lines that don't decode) of JSON messages that arrive as files in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    read = lines.select("value", F.from_json("value", schema + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("m"))
    broken = F.col("m.broken").isNotNull() | F.col("m").isNull()
    return read.where(~broken).select("m.*").drop("broken"), read.where(broken).select("value")
