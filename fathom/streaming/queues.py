"""Ready queues in state, and verdicts that meet their leases, over streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "queue string, seq long, op string, task long, priority long, enqueued long"
POPPED = "queue string, seq long, task long, priority long, enqueued long"


class ReadyQueue(StatefulProcessor):
    """One queue: its waiting tasks by place, and the priority that each task was last pushed with.

    A batch that pops reads the waiting places once into a heap; one that only
    pushes reads none of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "back long, enqueued long, seq long", "task long")
        self.remembered = handle.getMapState("remembered", "task long", "priority long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        heap: list[tuple[int, int, int]] | None = None
        for c in sorted(rows, key=lambda r: r.seq):
            if c.op == "pop":
                if heap is None:
                    heap = [tuple(k) for k in self.waiting.keys()]
                    heapq.heapify(heap)
                if not heap:
                    yield Row(queue=key[0], seq=c.seq, task=None, priority=None, enqueued=None)
                    continue
                place = heapq.heappop(heap)
                task = self.waiting.getValue(place)[0]
                self.waiting.removeKey(place)
                yield Row(queue=key[0], seq=c.seq, task=task, priority=-place[0], enqueued=place[1])
                continue
            if c.op == "push":
                priority = c.priority or 0
                self.remembered.updateValue((c.task,), (priority,))
            else:  # requeue: at the priority that the task came with
                priority = self.remembered.getValue((c.task,))[0] if self.remembered.containsKey((c.task,)) else 0
            place = (-priority, c.enqueued, c.seq)
            self.waiting.updateValue(place, (c.task,))
            if heap is not None:
                heapq.heappush(heap, place)

    def close(self) -> None:
        pass


def pops(commands: DataFrame) -> DataFrame:
    """What each pop of a stream of commands (push, requeue, pop) gives: highest priority first, then earliest enqueued, then lowest seq; nulls from an empty queue.

    Commands of a queue take effect in order of seq within a micro-batch, batches
    in order of arrival. Needs state in RocksDB.
    """
    return commands.groupBy("queue").transformWithState(statefulProcessor=ReadyQueue(), outputStructType=POPPED, outputMode="append", timeMode="none")


def credited(verdicts: DataFrame, leases: DataFrame, within: str = "1 hour") -> DataFrame:
    """(worker, seq, detail, at) of verdicts (task, epoch, seq, detail, at) whose lease (task, epoch, holder, granted) was granted at most ``within`` before.

    Both sides wait for each other in state, which their watermarks free: a lease
    once no verdict can come in time for it, a verdict once its lease is overdue.
    """
    v = verdicts.select(F.col("task").alias("v_task"), F.col("epoch").alias("v_epoch"), "seq", "detail", "at").withWatermark("at", within)
    g = leases.select("task", "epoch", "holder", "granted").withWatermark("granted", within)
    fits = (F.col("v_task") == F.col("task")) & (F.col("v_epoch") == F.col("epoch")) & (F.col("at") >= F.col("granted")) & F.expr(f"at <= granted + interval {within}")
    return v.join(g, fits).select(F.col("holder").alias("worker"), "seq", "detail", "at")
