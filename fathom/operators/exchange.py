"""What a dispatcher decides about messages, as joins: lookups, inserts, submissions, heartbeats, verdicts, stitching.

A lookup that fails or a message that is fenced off is a row with its reason,
never an exception.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reputation, scalars

#: Names of stored states.
STATUSES = {"pending": "Pending", "leased": "Leased", "submitted": "Submitted", "verifying": "Verifying", "accepted": "Accepted", "failed": "Failed"}
#: Kinds of return frames by their leading byte.
FRAME_KINDS = {0: "heartbeat", 1: "submission", 2: "verdict"}
#: Fields of each kind of frame.
FRAME_FIELDS = {"heartbeat": ("task", "worker", "epoch"), "submission": ("task", "worker", "epoch"), "verdict": ("task", "passed")}


def get_blobs(requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """requests (address, ...) with payload and status Found or NotFound, from blobs (address, payload)."""
    held = blobs.select("address", "payload", F.lit(True).alias("__held"))
    joined = requests.join(held, "address", "left")
    return joined.select(*requests.columns, "payload", F.when(F.col("__held"), "Found").otherwise("NotFound").alias("status"))


def get_keys(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """segments (job, segment, ...) with key and status, from keys (job, segment, key)."""
    joined = segments.join(keys.select("job", "segment", "key"), ["job", "segment"], "left")
    return joined.select(*segments.columns, "key", F.when(F.col("key").isNull(), "NotFound").otherwise("Found").alias("status"))


def snapshots(stored: DataFrame) -> DataFrame:
    """Typed task rows from (task, fields), fields a map of strings; error names a missing field or an unknown status.

    A number that doesn't parse is 0; a commitment that isn't 64 hex digits is null. A task without fields has no row.
    """
    field = lambda k: F.try_element_at("fields", F.lit(k))
    number = lambda k: F.coalesce(field(k).try_cast("bigint"), F.lit(0).cast("bigint"))
    state = reputation.pick(field("status"), STATUSES)
    live, named = state.isin("Leased", "Submitted", "Verifying"), state.isin("Submitted", "Verifying", "Accepted")
    needed = {"status": F.lit(True), "kind": F.lit(True), "epoch_hw": F.lit(True), "retries": F.lit(True), "holder": live, "epoch": live, "deadline": state == "Leased", "commitment": named, "output": named}
    missing = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)) & field(k).isNull(), F.lit(k)) for k, when in needed.items())), lambda x: x.isNotNull())
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing field "), F.get(missing, F.lit(0)))).when(state.isNull(), F.concat(F.lit("unknown status "), field("status")))
    good = error.isNull()
    only = lambda when, c: F.when(good & when, c)
    kept = stored.where(F.size("fields") > 0)
    return kept.select(
        "task", error.alias("error"), only(F.lit(True), state).alias("status"), only(live, number("holder")).alias("holder"), only(live, number("epoch")).alias("epoch"), only(state == "Leased", number("deadline")).alias("deadline"),
        only(named, hex_bytes(field("commitment"), 32)).alias("commitment"), only(named, number("output")).alias("output"), only(F.lit(True), number("epoch_hw")).alias("epoch_hw"), only(F.lit(True), number("retries")).alias("retries"),
    )


def hex_bytes(text: Column, size: int) -> Column:
    """The hex text of exactly size bytes in lower case, else null."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.lower(text))


def create_tasks(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (task, seq) with outcome Created or TaskExists: the first of an id that isn't there yet is created."""
    first = new.groupBy("task").agg(F.min("seq").alias("__first"))
    there = existing.select("task", F.lit(True).alias("__there")).distinct()
    joined = new.join(first, "task").join(there, "task", "left")
    outcome = F.when(F.col("__there").isNull() & (F.col("seq") == F.col("__first")), "Created").otherwise("TaskExists")
    return joined.select("task", "seq", outcome.alias("outcome"))


def candidate_loads(candidates: DataFrame, workers: DataFrame, strict: bool = False) -> DataFrame:
    """candidates (worker, tier) with live load; an unknown worker is a row with error, or fails the job if strict."""
    joined = candidates.join(workers.select("worker", "in_flight", "ewma", "last_heartbeat"), "worker", "left")
    unknown = F.when(F.col("in_flight").isNull(), F.raise_error(F.concat(F.lit("unknown worker "), F.col("worker").cast("string"))).cast("string") if strict else F.lit("UnknownWorker"))
    return joined.select("worker", "tier", "in_flight", "ewma", "last_heartbeat", unknown.alias("error"))


def fenced(error: Column) -> Column:
    return error.isin("StaleEpoch", "WrongHolder")


def submission_decisions(steps: DataFrame, tiers: DataFrame) -> DataFrame:
    """(task, seq, worker, outcome) of every Submit of replayed steps (with worker): fence, then the sampling gate of the worker's tier.

    The tier is that of tiers (worker, tier), else the best; the draw is a hash of task and seq.
    """
    sent = steps.where("event = 'Submit'").join(tiers.select("worker", "tier"), "worker", "left").withColumn("tier", F.coalesce("tier", F.lit(0)))
    draw = scalars.uniform(F.concat(F.lit("submit:"), F.col("task").cast("string"), F.lit(":"), F.col("seq").cast("string")).cast("binary"))
    outcome = F.when(fenced(F.col("error")), "RejectedZombie").when(F.col("error").isNotNull(), F.col("error")).when(draw < reputation.share_for(F.col("tier")), "Sampled").otherwise("Accepted")
    return sent.select("task", "seq", "worker", outcome.alias("outcome"))


def heartbeat_outcomes(steps: DataFrame) -> DataFrame:
    """(task, seq, worker, outcome, deadline) of every Heartbeat: Extended, Rejected if fenced off, else the error."""
    outcome = F.when(F.col("error").isNull(), "Extended").when(fenced(F.col("error")), "Rejected").otherwise(F.col("error"))
    return steps.where("event = 'Heartbeat'").select("task", "seq", "worker", outcome.alias("outcome"), F.when(F.col("error").isNull(), F.col("deadline")).alias("deadline"))


def liveness(heartbeats: DataFrame) -> DataFrame:
    """(worker, last_heartbeat): the last heartbeat that was taken; a rejected one refreshes nothing."""
    return heartbeats.where("outcome = 'Extended'").groupBy("worker").agg(F.max("seq").alias("last_heartbeat"))


def verdict_outcomes(steps: DataFrame) -> DataFrame:
    """(task, seq, holder, outcome) of every VerifyOutcome: Accepted, Requeued, Failed, or the error."""
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") == "Accepted", "Accepted").when(F.col("status") == "Pending", "Requeued").otherwise("Failed")
    return steps.where("event = 'VerifyOutcome'").select("task", "seq", "holder", outcome.alias("outcome"))


def route(frames: DataFrame, tag: Column, body: Column) -> DataFrame:
    """frames with kind (heartbeat, submission, verdict or malformed) and the decoded message.

    tag is the leading number and body JSON; an unknown tag, an empty frame or a
    body that lacks one of its kind's fields is malformed.
    """
    message = F.from_json(body, "task long, worker long, epoch long, passed boolean")
    decoded = frames.withColumn("__m", message)
    known = reputation.pick(tag, FRAME_KINDS)
    whole = F.lit(False)
    for kind, fields in FRAME_FIELDS.items():
        there = F.lit(True)
        for f in fields:
            there = there & F.col(f"__m.{f}").isNotNull()
        whole = F.when(known == kind, there).otherwise(whole)
    kind = F.when(F.col("__m").isNotNull() & whole, known).otherwise("malformed")
    return decoded.withColumn("kind", kind).select(*frames.columns, "kind", *(F.when(F.col("kind") != "malformed", F.col(f"__m.{f}")).alias(f) for f in ("task", "worker", "epoch", "passed")))


def bound(blobs: DataFrame) -> DataFrame:
    """(address, commitment) of blobs (address, payload), recomputed from the bytes."""
    return blobs.select("address", scalars.commitment_of_one(F.col("payload")).alias("commitment"), scalars.content_address(F.col("payload")).alias("actual")).distinct()


def verify_stitches(requests: DataFrame, inputs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(task, detail) of requests (task, output, commitment) over their inputs (task, place, output, commitment).

    A missing output is inconclusive and an unbound one a mismatch; then a missing
    input is inconclusive, and an input whose bytes don't give its commitment and
    address is an integrity violation. No inputs are in order.
    """
    held = bound(blobs)
    own = requests.join(held.withColumnsRenamed({"address": "output", "commitment": "held"}), "output", "left")
    fetched = inputs.join(held.withColumnsRenamed({"address": "output", "commitment": "held"}), "output", "left")
    right = (F.col("held") == F.col("commitment")) & (F.col("actual") == F.col("output"))
    by = fetched.groupBy("task").agg(F.some(F.col("held").isNull()).alias("absent"), F.every(F.coalesce(right, F.lit(False))).alias("right"))
    detail = F.when(F.col("held").isNull(), "Inconclusive").when(F.col("held") != F.col("commitment"), "CommitmentMismatch").when(F.col("absent"), "Inconclusive").when(~F.col("right"), "IntegrityViolation").otherwise("Ok")
    return own.join(by, "task", "left").select("task", detail.alias("detail"))


def stitch(inputs: DataFrame) -> DataFrame:
    """(task, payload): the payloads of inputs (task, place, payload) in order, as one."""
    by = inputs.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("place", F.hex("payload").alias("payload")))).alias("rows"))
    return by.select("task", F.unhex(F.array_join("rows.payload", "")).alias("payload"))


def verify_requests(requests: DataFrame, transcodes: DataFrame, stitches: DataFrame) -> DataFrame:
    """(task, kind, passed, detail) of requests (task, kind), each from the verdicts (task, detail) of its kind; none is inconclusive."""
    verdicts = transcodes.select("task", F.lit("transcode").alias("kind"), "detail").unionByName(stitches.select("task", F.lit("stitch").alias("kind"), "detail"))
    detail = F.coalesce("detail", F.lit("Inconclusive"))
    return requests.join(verdicts, ["task", "kind"], "left").select("task", "kind", (detail == "Ok").alias("passed"), detail.alias("detail"))


def stage(sources: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """Segments of size characters of sources (job, text): (job, segment, plain, source, sealed), sealed by keys (job, segment, key).

    The nonce is a hash of key and place, so that rows repeat; a live workload leaves it to the cipher.
    """
    cut = sources.select("job", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / size).cast("int")), lambda k: F.substr("text", k * size + 1, F.lit(size)))).alias("segment", "plain"))
    cut = cut.where("plain <> ''").withColumn("segment", F.col("segment").cast("bigint")).join(keys, ["job", "segment"])
    nonce = F.substring(F.unhex(F.sha2(F.concat("key", F.col("segment").cast("string").cast("binary")), 256)), 1, 12)
    sealed = scalars.seal(F.col("plain").cast("binary"), F.col("key"), scalars.associated_data(F.col("job"), F.col("segment"), F.lit(0)), nonce)
    return cut.withColumn("sealed", sealed).select("job", "segment", "plain", scalars.content_address(F.col("sealed")).alias("source"), "sealed")


def substitutes(pieces: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, segment, other_job, other_segment): each piece with that of the next job, at the same place or its last one.

    pieces are (job, segment), segments numbered from 0; jobs are (job, place), the last is followed by the first.
    """
    sizes = pieces.groupBy("job").agg((F.max("segment")).alias("top"))
    n = jobs.agg(F.count("*").alias("n"))
    ring = jobs.crossJoin(F.broadcast(n)).select("job", ((F.col("place") + 1) % F.col("n")).alias("place"))
    following = ring.join(jobs.withColumnRenamed("job", "other_job"), "place").join(sizes.withColumnRenamed("job", "other_job"), "other_job")
    return pieces.join(following, "job").select("job", "segment", "other_job", F.least("segment", "top").alias("other_segment"))


def coarse_standings(changes: DataFrame) -> DataFrame:
    """(worker, standing) after coarse changes (worker, seq, change) in order; they only lower, so the floor is all that clamps."""
    total = changes.groupBy("worker").agg(F.sum(reputation.coarse_delta(F.col("change"))).alias("total"))
    return total.select("worker", F.greatest(F.lit(reputation.FLOOR), F.col("total")).cast("int").alias("standing"))


def steady_half(series: DataFrame, place: str, values: Sequence[str], *keys: str) -> DataFrame:
    """Means of values over the later half (from n div 2 on) of each key's series, places from 0."""
    counts = series.groupBy(*keys).agg(F.count("*").alias("__n"))
    late = series.join(counts, list(keys)).where(F.col(place) >= F.floor(F.col("__n") / 2))
    return late.groupBy(*keys).agg(F.count("*").alias("samples"), *(F.avg(v).alias(v) for v in values))
