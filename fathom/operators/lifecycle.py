"""Ordered folds over task events and over verdicts, as plan-level aggregates without Python.

A task's events form one array. Tasks are expected to be many and short; a task
of unbounded length belongs to the streaming form, which keeps one state row.
A worker's verdicts may be many: clamped additions compose, as do the affine maps
of a moving average, so both are ordered scans that no single task sees whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reputation, scalars
from ..plans import rules
from . import scan

#: Events of a log that are folded into one array at a time, at least.
BLOCK = 8
_EVENT = ("seq", "event", "worker", "epoch", "deadline", "passed")


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _steps(logs: DataFrame, keep: str = "true", carried: tuple[str, ...] = ()) -> DataFrame:
    """The steps r for which keep holds, of task and log (an array of _EVENT and carried in order), with carried of their events.

    Spark copies what an aggregate has gathered at each element, so steps are gathered in blocks of a length that is
    the root of the log's: an event costs copies of so many steps and not of all before it. An event's error is
    found once. Inline is outer, because Spark would else evaluate the fold twice to see whether it is empty.
    """
    judged = {k: v.replace(f"({rules.ERROR})", "x.error") for k, v in (rules.NEXT | {"error": "x.error", "actions": rules.ACTIONS}).items()}
    step = _struct(judged | {"seq": "e.seq", "event": "e.event", "was": "s.status"} | {c: f"e.{c}" for c in carried})
    start = _struct(rules.START | {"error": "CAST(NULL AS STRING)", "actions": "''", "seq": "CAST(0 AS BIGINT)", "event": "''", "was": "''"} | {c: f"get(log, 0).{c}" for c in carried})
    block = f"greatest({BLOCK}, cast(ceil(sqrt(size(log))) AS INT))"
    parts = f"transform(sequence(0, (size(log) - 1) div {block}), b -> slice(log, cast(b * {block} + 1 AS INT), {block}))"
    taken = f"transform(array(element_at(acc, -1)), s -> transform(array(named_struct('error', {rules.ERROR})), x -> {step})[0])"
    within = f"slice(aggregate(part, array(a.last), (acc, e) -> concat(acc, {taken})), 2, size(part))"
    joined = f"transform(array({within}), r -> named_struct('last', element_at(r, -1), 'done', concat(a.done, array(filter(r, r -> {keep})))))[0]"
    fold = f"aggregate({parts}, named_struct('last', {start}, 'done', array(array({start}))), (a, part) -> {joined}, a -> flatten(slice(a.done, 2, size(a.done))))"
    return logs.select("task", F.expr(fold).alias("steps")).select("task", F.inline_outer("steps")).where("status is not null")


def replay(events: DataFrame) -> DataFrame:
    """A row per event in order: state before and after, error and actions."""
    return _steps(events.groupBy("task").agg(F.sort_array(F.collect_list(F.struct(*_EVENT))).alias("log")))


def clocked(events: DataFrame, keep: str = "true", carried: tuple[str, ...] = ()) -> DataFrame:
    """Steps of events (with now, a clock that rises with seq) where the clock meets a task before each of its events, and all tasks at its end.

    As replay, with seq doubled: even steps are the clock's. Of carried columns
    a step has the last value that the task's events brought up to it (of those
    of one seq the greatest). The clock's steps are put into a task's log, so
    events are dealt to tasks once.
    """
    so_far = Window.partitionBy("task").orderBy("seq")
    brought = lambda c: F.max(F.when(F.col(c).isNotNull() & F.col("seq").isNotNull(), F.struct("seq", c)))
    ends = events.agg(F.max("now").alias("__now"), F.max("seq").alias("__seq"))  # one row
    dealt = events.withColumns({f"__{c}": brought(c).over(so_far)[c] for c in carried})
    logs = dealt.groupBy("task").agg(F.collect_list(F.struct(*_EVENT, "now", *(f"__{c}" for c in carried))).alias("own"), *(brought(c)[c].alias(f"__{c}") for c in carried)).crossJoin(F.broadcast(ends))

    def entry(seq: Column, event: Column, deadline: Column, values: list[Column], own: Column | None = None) -> Column:
        kept = {c: F.lit(None).cast(t) if own is None else own[c].cast(t) for c, t in (("worker", "bigint"), ("epoch", "bigint"), ("passed", "boolean"))}
        named = {"seq": seq.cast("bigint"), "event": event, "deadline": deadline.cast("bigint")} | kept
        return F.struct(*(named[c].alias(c) for c in _EVENT), *(v.alias(c) for c, v in zip(carried, values, strict=True)))

    of = lambda e: [e[f"__{c}"] for c in carried]
    ticks = F.transform("own", lambda e: entry(2 * e["seq"], F.lit("Tick"), e["now"], of(e)))
    own = F.transform("own", lambda e: entry(2 * e["seq"] + 1, e["event"], e["deadline"], of(e), e))
    last = entry(2 * F.col("__seq") + 2, F.lit("Tick"), F.col("__now"), [F.col(f"__{c}") for c in carried])
    return _steps(logs.select("task", F.sort_array(F.concat(ticks, own, F.array(last))).alias("log")), keep, carried)


def reclaims(events: DataFrame) -> DataFrame:
    """(task, seq, epoch, deadline, priority) of every lease that the clock of events ended; priority is the last that the task's events brought before."""
    ended = clocked(events, "r.event = 'Tick' AND r.was = 'Leased' AND r.status = 'Pending'", ("priority",))
    return ended.select("task", F.expr("seq div 2").alias("seq"), "epoch", "deadline", "priority")


def final_states(events: DataFrame) -> DataFrame:
    """The state of every task after all its events."""
    ordered = events.groupBy("task").agg(F.sort_array(F.collect_list(F.struct(*_EVENT))).alias("log"))
    fold = f"aggregate(log, {_struct(rules.START)}, (s, e) -> {_struct(rules.NEXT)})"
    return ordered.select("task", F.expr(fold).alias("state")).select("task", "state.*")


def _bounds(off: Column, lo: Column, hi: Column) -> Column:
    return F.struct(off.cast("bigint").alias("off"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _through(s: Column, f: Column) -> Column:
    return F.least(f["hi"].cast("bigint"), F.greatest(f["lo"].cast("bigint"), s + f["off"])).cast("int")


#: Clamped additions: (off, lo, hi) takes a standing s to least(hi, greatest(lo, s + off)); two of them make one.
CLAMPED = scan.Monoid(lambda: _bounds(F.lit(0), F.lit(reputation.FLOOR), F.lit(0)), lambda a, b: _bounds(a["off"] + b["off"], _through(a["lo"], b), _through(a["hi"], b)))
#: Affine maps: (mult, add) takes s to mult * s + add; two of them make one.
AFFINE = scan.Monoid(lambda: F.struct(F.lit(1.0).alias("mult"), F.lit(0.0).alias("add")), lambda a, b: F.struct((a["mult"] * b["mult"]).alias("mult"), (b["mult"] * a["add"] + b["add"]).alias("add")))


def step(detail: Column) -> Column:
    """What a verdict does to a standing, as a value of CLAMPED."""
    return _bounds(reputation.verdict_delta(detail), F.lit(reputation.FLOOR), F.lit(0))


def ewma_step(x: Column, alpha: float = scalars.EWMA_ALPHA) -> Column:
    """What an observation does to its moving average, as a value of AFFINE."""
    return F.struct(F.lit(1 - alpha).alias("mult"), (F.lit(alpha) * x.cast("double")).alias("add"))


def standings(verdicts: DataFrame) -> DataFrame:
    """(worker, verdicts, standing) after all verdicts (worker, seq, detail) in order."""
    ends = scan.total(verdicts, ["worker"], ["seq"], step(F.col("detail")), CLAMPED)
    return ends.select("worker", F.col("rows").alias("verdicts"), _through(F.lit(0), F.col("value")).alias("standing"))


def trajectories(verdicts: DataFrame) -> DataFrame:
    """A row per verdict: standing before and after."""
    found = scan.scan(verdicts.select("worker", "seq", "detail"), ["worker"], ["seq"], step(F.col("detail")), CLAMPED)
    return found.select("worker", "seq", "detail", _through(F.lit(0), F.col("before")).alias("before"), _through(F.lit(0), F.col("after")).alias("after"))


def moving_averages(series: DataFrame, keys: list[str], order: list[str], x: Column, alpha: float = scalars.EWMA_ALPHA) -> DataFrame:
    """keys and ewma, the moving average after all rows in order; it starts from 0."""
    return scan.total(series, keys, order, ewma_step(x, alpha), AFFINE).select(*keys, F.col("value.add").alias("ewma"))
