"""Leases with a timer each, over a stream of task events, by Spark's arbitrary state and timer service.

A task keeps three state variables: where it stands in its lifecycle, the priority
that it came with, and the time its timer is armed for. A grant arms the timer at
the lease's deadline, a heartbeat that is taken moves it, whatever else ends the
lease disarms it. The watermark is the reclaim clock. A task's own events carry
the clock as well, so a late event finds its lease ended whether or not the timer
has fired: results don't depend on how rows fall into micro-batches. A task that
has ended is forgotten ``keep`` seconds later, again by a timer.

State lives in RocksDB under the query's checkpoint; ``use_rocksdb`` sets the
provider that Spark asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tasks import START, advance, rejection

STEP = "task long, seq long, event string, was string, status string, holder long, epoch long, deadline long, error string, priority long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams of this session keep their state in RocksDB, which timers and several state variables need."""
    spark.conf.set(_PROVIDER, _ROCKS)


class Leases(StatefulProcessor):
    """One task: its lifecycle state, remembered priority and timer."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, holder long, epoch long, deadline long, epoch_hw long, retries long")
        self.priority = handle.getValueState("priority", "priority long")
        self.armed = handle.getValueState("armed", "at long")

    def _arm(self, at: int | None) -> None:
        """One timer at a time: the old one goes before the next is registered."""
        before = self.armed.get()[0] if self.armed.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.armed.clear()
        else:
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def _remembered(self) -> int | None:
        return self.priority.get()[0] if self.priority.exists() else None

    def _lapse(self, task: int, state: tuple) -> tuple[tuple, Row]:
        """The state after its lease has run out, epoch and deadline kept, and the row that says so."""
        after = ("Pending", *state[1:])
        return after, Row(task=task, seq=None, event="LeaseExpired", was="Leased", status="Pending", holder=state[1], epoch=state[2], deadline=state[3], error=None, priority=self._remembered())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.task.get()) if self.task.exists() else START
        ended = None
        for e in sorted(rows, key=lambda r: r.seq):
            if e.priority is not None:
                self.priority.update((e.priority,))
            if state[0] == "Leased" and state[3] <= e.now:
                state, row = self._lapse(key[0], state)
                yield row
            error, was = rejection(state, e), state[0]
            if error is None:
                state = advance(state, e)
            ended = e.now
            yield Row(task=key[0], seq=e.seq, event=e.event, was=was, status=state[0], holder=state[1], epoch=state[2], deadline=state[3], error=error, priority=None)
        self.task.update(state)
        clock = timerValues.getCurrentWatermarkInMs()
        if state[0] == "Leased":
            self._arm(max(state[3] * 1000, clock))
        elif state[0] in ("Accepted", "Failed"):
            self._arm(max((ended + self.keep) * 1000, clock))
        else:
            self._arm(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.armed.clear()
        state = tuple(self.task.get())
        if state[0] == "Leased":
            state, row = self._lapse(key[0], state)
            self.task.update(state)
            yield row
        else:
            self.task.clear()
            self.priority.clear()

    def close(self) -> None:
        pass


def with_timers(events: DataFrame, keep: int = 86_400) -> DataFrame:
    """A row per event of a stream, and one per lease that ran out, with the priority at which its task is queued again.

    events has task, seq, event, worker, epoch, deadline, passed, now (the clock in
    seconds, rising with seq within a task) and priority (null where the event
    brings none).
    """
    timed = events.withColumn("at", F.timestamp_seconds("now")).withWatermark("at", "0 seconds")
    return timed.groupBy("task").transformWithState(statefulProcessor=Leases(keep), outputStructType=STEP, outputMode="append", timeMode="eventTime")
