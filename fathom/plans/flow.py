"""Registered queries of the message-handling operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reputation, scalars
from ..operators import exchange, lifecycle
from ..operators.ordered import in_order
from ..sources import tables as T
from .catalog import formula, query
from .registry import _VERDICTS, verdicts
from .twins import FOLD

_ADDRESS = "substr(sha256({0}), 1, 32)"
_COMMITMENT = "sha256('\\x00'::BLOB || unhex(sha256({0})))"


def _documents(spark, d):
    return T.table(spark, d, "documents")


def _blobs(spark, d, where: str = "true"):
    payload = F.col("text").cast("binary")
    return _documents(spark, d).where(where).select(scalars.content_address(payload).alias("address"), payload.alias("payload")).dropDuplicates(["address"])


# Lookups ------------------------------------------------------------------------------------------------------------------------------
@query(f"WITH b AS (SELECT DISTINCT {_ADDRESS.format('text')} AS address, text FROM documents WHERE doc_id % 5 <> 0) SELECT d.doc_id AS task, CASE WHEN b.address IS NULL THEN 'NotFound' ELSE 'Found' END AS status, strlen(b.text)::BIGINT AS bytes FROM documents d LEFT JOIN b ON b.address = {_ADDRESS.format('d.text')}")
def blob_lookup(spark, d):
    """Blobs by content address; four fifths of the documents are stored."""
    asked = _documents(spark, d).select(F.col("doc_id").alias("task"), scalars.content_address(F.col("text").cast("binary")).alias("address"))
    found = exchange.get_blobs(asked, _blobs(spark, d, "doc_id % 5 <> 0"))
    return found.select("task", "status", F.length("payload").cast("bigint").alias("bytes"))


def _keys(spark, d, where: str = "true"):
    segments = T.table(spark, d, "conversations").where(where).select(F.col("conv_id").alias("job"), F.col("turn").alias("segment")).distinct()
    return segments.withColumn("key", F.unhex(F.sha2(F.concat_ws("-", "job", "segment").cast("binary"), 256)))


@query("WITH s AS (SELECT DISTINCT conv_id AS job, turn AS segment FROM conversations) SELECT job, segment, CASE WHEN turn_known THEN 'Found' ELSE 'NotFound' END AS status, CASE WHEN turn_known THEN sha256(job || '-' || segment) END AS key FROM (SELECT *, job % 4 <> 1 OR segment = 0 AS turn_known FROM s)")
def key_lookup(spark, d):
    """Keys by job and segment; some jobs have a key for their first segment only."""
    asked = T.table(spark, d, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("segment")).distinct()
    return exchange.get_keys(asked, _keys(spark, d, "conv_id % 4 <> 1 or turn = 0")).select("job", "segment", "status", F.lower(F.hex("key")).alias("key"))


_STORED = """SELECT o_orderkey AS task, CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 2 THEN 'submitted' WHEN 3 THEN 'verifying' WHEN 4 THEN 'accepted' WHEN 5 THEN 'failed' WHEN 6 THEN 'lost' END AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR(20)) END AS holder, CAST(o_orderkey % 9 AS VARCHAR(20)) AS epoch, CAST(o_custkey + 100 AS VARCHAR(20)) AS deadline,
 CASE WHEN o_orderkey % 3 = 0 THEN 'beef' ELSE repeat('0A', 32) END AS commitment FROM orders"""
_MISSING = "CASE WHEN status IS NULL THEN 'missing field status' WHEN status IN ('leased', 'submitted', 'verifying') AND holder IS NULL THEN 'missing field holder' WHEN status = 'lost' THEN 'unknown status lost' END"


@query(f"""WITH e AS (SELECT *, {_MISSING} AS error FROM ({_STORED}))
SELECT task, error, CASE WHEN error IS NULL THEN upper(status[1]) || substr(status, 2) END AS status, CASE WHEN error IS NULL AND status IN ('leased', 'submitted', 'verifying') THEN coalesce(try_cast(holder AS BIGINT), 0) END AS holder,
 CASE WHEN error IS NULL AND status IN ('leased', 'submitted', 'verifying') THEN epoch::BIGINT END AS epoch, CASE WHEN error IS NULL AND status = 'leased' THEN deadline::BIGINT END AS deadline,
 CASE WHEN error IS NULL AND status IN ('submitted', 'verifying', 'accepted') AND commitment <> 'beef' THEN lower(commitment) END AS commitment, CASE WHEN error IS NULL AND status IN ('submitted', 'verifying', 'accepted') THEN task END AS output,
 CASE WHEN error IS NULL THEN epoch::BIGINT END AS epoch_hw, CASE WHEN error IS NULL THEN 0::BIGINT END AS retries FROM e""")
def task_snapshot(spark, d):
    """Typed tasks out of stored string fields."""
    rows = T.derived(spark, d, _STORED)
    fields = {"status": F.col("status"), "holder": F.col("holder"), "epoch": F.col("epoch"), "deadline": F.col("deadline"), "commitment": F.col("commitment"), "output": F.col("task").cast("string"), "epoch_hw": F.col("epoch"), "retries": F.lit("none"), "kind": F.lit("transcode")}
    packed = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return exchange.snapshots(rows.select("task", packed.alias("fields")))


@query("SELECT c_custkey AS worker, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END WHEN 2 THEN NULL ELSE (-c_custkey)::BIGINT END AS number, CASE WHEN c_custkey % 4 = 2 THEN repeat('ff', 4) END AS bytes FROM customer")
def decode_fields(spark, d):
    """Store replies decoded: numbers that parse, hex of four bytes, else null."""
    rows = T.table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 4 == 0, "12x").when(F.col("c_custkey") % 4 == 1, F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("string"))).when(F.col("c_custkey") % 4 == 2, "FFffFFff").otherwise((-F.col("c_custkey")).cast("string"))
    rows = rows.withColumn("t", text)
    return rows.select(F.col("c_custkey").alias("worker"), F.when(F.col("c_custkey") % 4 != 2, F.col("t").try_cast("bigint")).alias("number"), exchange.hex_bytes(F.col("t"), 4).alias("bytes"))


# Inserts and placement ----------------------------------------------------------------------------------------------------------------
@query("WITH n AS (SELECT l_orderkey AS task, min(l_extendedprice) AS seq FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, max(l_extendedprice) + 1 FROM lineitem GROUP BY l_orderkey) SELECT n.task, n.seq, CASE WHEN o.o_orderkey IS NULL AND n.seq = min(n.seq) OVER (PARTITION BY n.task) THEN 'Created' ELSE 'TaskExists' END AS outcome FROM n LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) o ON o.o_orderkey = n.task")
def create_tasks(spark, d):
    """Two requests for each order's task, a third of which exist."""
    by = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    new = by.select("task", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("seq"))
    return exchange.create_tasks(new, T.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task")))


@query(f"SELECT c.worker, c.tier, w.in_flight, w.ewma, w.last_heartbeat, CASE WHEN w.worker IS NULL THEN 'UnknownWorker' END AS error FROM (SELECT c_custkey AS worker, (c_custkey % 5)::INT AS tier FROM customer WHERE c_custkey % 3 = 0) c LEFT JOIN ({T.WORKERS}) w ON w.worker = c.worker")
def candidate_loads(spark, d):
    """Candidates with their live load; those that never registered are named."""
    candidates = T.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("worker"), (F.col("c_custkey") % 5).cast("int").alias("tier"))
    return exchange.candidate_loads(candidates, T.derived(spark, d, T.WORKERS))


@query("SELECT count(*) AS depth FROM orders WHERE o_orderstatus = 'O'")
def queue_depth(spark, d):
    return T.table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("depth"))


# Messages -----------------------------------------------------------------------------------------------------------------------------
def _steps(spark, d):
    """Replayed events with the worker that each names."""
    events = T.derived(spark, d, T.TASK_EVENTS)
    return lifecycle.replay(events).join(events.select("task", "seq", "worker"), ["task", "seq"])


_STEPS = f"{FOLD}, st AS (SELECT f.*, ev.worker FROM f JOIN ev ON ev.task = f.task AND ev.seq = f.seq WHERE f.rn > 0)"
_DRAW = "('0x' || substr(sha256('submit:' || task || ':' || seq), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"WITH RECURSIVE {_STEPS} SELECT task, seq, worker, CASE WHEN error IN ('StaleEpoch', 'WrongHolder') THEN 'RejectedZombie' WHEN error IS NOT NULL THEN error WHEN {_DRAW} < CASE WHEN worker = 2 THEN 0.25 ELSE 0.02 END THEN 'Sampled' ELSE 'Accepted' END AS outcome FROM st WHERE event = 'Submit'")
def submission_decisions(spark, d):
    """Submissions: fenced off, refused, taken into the sample or accepted; worker 2 is known as suspect."""
    tiers = spark.createDataFrame([(2, 2)], "worker long, tier int")
    return exchange.submission_decisions(_steps(spark, d), tiers)


@query(f"WITH RECURSIVE {_STEPS} SELECT task, seq, worker, CASE WHEN error IS NULL THEN 'Extended' WHEN error IN ('StaleEpoch', 'WrongHolder') THEN 'Rejected' ELSE error END AS outcome, CASE WHEN error IS NULL THEN deadline END AS deadline FROM st WHERE event = 'Heartbeat'")
def heartbeat_outcomes(spark, d):
    return exchange.heartbeat_outcomes(_steps(spark, d))


@query(f"WITH RECURSIVE {_STEPS} SELECT worker, max(seq) AS last_heartbeat FROM st WHERE event = 'Heartbeat' AND error IS NULL GROUP BY worker")
def worker_liveness(spark, d):
    return exchange.liveness(heartbeat_outcomes(spark, d))


@query(f"WITH RECURSIVE {_STEPS} SELECT task, seq, holder, CASE WHEN error IS NOT NULL THEN error WHEN status = 'Pending' THEN 'Requeued' ELSE status END AS outcome FROM st WHERE event = 'VerifyOutcome'")
def verdict_outcomes(spark, d):
    return exchange.verdict_outcomes(_steps(spark, d))


_DETAIL = "CASE outcome WHEN 'Accepted' THEN 'Ok' WHEN 'Requeued' THEN CASE seq % 3 WHEN 0 THEN 'FidelityBelowThreshold' WHEN 1 THEN 'IntegrityViolation' ELSE 'Inconclusive' END ELSE 'CommitmentMismatch' END"


@query(f"""WITH RECURSIVE {_STEPS}, o AS (SELECT holder, seq, {_DETAIL.replace('outcome', "(CASE WHEN status = 'Pending' THEN 'Requeued' ELSE status END)")} AS detail FROM st WHERE event = 'VerifyOutcome' AND error IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY seq) AS rn FROM o),
z(holder, rn, s) AS (SELECT holder, 0::BIGINT, 0 FROM (SELECT DISTINCT holder FROM k) UNION ALL SELECT k.holder, k.rn, greatest(-128, least(0, z.s + CASE k.detail WHEN 'Ok' THEN 1 WHEN 'FidelityBelowThreshold' THEN -8 WHEN 'IntegrityViolation' THEN -32 WHEN 'CommitmentMismatch' THEN -64 ELSE 0 END)) FROM z JOIN k ON k.holder = z.holder AND k.rn = z.rn + 1)
SELECT holder AS worker, max(rn) AS verdicts, arg_max(s, rn)::INT AS standing FROM z GROUP BY holder""")
def verdict_standings(spark, d):
    """Standings of holders after every verdict that their tasks took."""
    taken = verdict_outcomes(spark, d).where("outcome in ('Accepted', 'Requeued', 'Failed')")
    return lifecycle.standings(taken.select(F.col("holder").alias("worker"), "seq", F.expr(_DETAIL).alias("detail")))


@query("SELECT user_id AS worker, greatest(-128, sum(CASE event_type WHEN 'error' THEN -8 ELSE -4 END))::INT AS standing FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def coarse_standing(spark, d):
    """Standings after timeouts and failed verifications only."""
    rows = T.table(spark, d, "events").where("event_type in ('error', 'click')")
    return exchange.coarse_standings(rows.select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "VerificationFailure").otherwise("Timeout").alias("change")))


_FRAMES = """SELECT event_id, CAST(event_id % 5 AS INT) AS tag, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '{"task": "x"}' WHEN event_id % 5 = 2 AND event_id % 3 = 0 THEN '{"task": 1}' WHEN event_id % 5 = 2 THEN '{"task": 7, "passed": true}' ELSE '{"task": 7, "worker": 3, "epoch": 2}' END AS body FROM events"""


@query(f"SELECT kind, count(*) AS n, count(worker) AS workers FROM (SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR tag > 2 THEN 'malformed' WHEN tag = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'malformed' ELSE 'verdict' END WHEN tag = 0 THEN 'heartbeat' ELSE 'submission' END AS kind, CASE WHEN tag < 2 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN 3 END AS worker FROM ({_FRAMES})) GROUP BY kind")
def routed_frames(spark, d):
    """Return frames by kind; unknown tags, empty and undecodable bodies are malformed."""
    rows = T.table(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("tag"))
    e, tag = F.col("event_id"), F.col("tag")
    whole = F.lit('{"task": 7, "worker": 3, "epoch": 2}')
    body = F.when(e % 11 == 0, "").when(e % 13 == 0, '{"task": "x"}').when((tag == 2) & (e % 3 == 0), '{"task": 1}').when(tag == 2, '{"task": 7, "passed": true}').otherwise(whole)
    return exchange.route(rows.withColumn("body", body), F.col("tag"), F.col("body")).groupBy("kind").agg(F.count("*").alias("n"), F.count("worker").alias("workers"))


# Stitching and staging ----------------------------------------------------------------------------------------------------------------
_TURNS = f"i AS (SELECT conv_id AS task, turn AS place, text, {_ADDRESS.format('text')} AS a, {_COMMITMENT.format('text')} AS c FROM conversations)"
_WHOLE = f"w AS (SELECT task, string_agg(text, '' ORDER BY place) AS whole FROM i GROUP BY task)"


@query(f"WITH {_TURNS}, {_WHOLE} SELECT task, strlen(whole)::BIGINT AS bytes, {_ADDRESS.format('whole')} AS address, {_COMMITMENT.format('whole')} AS commitment FROM w")
def stitched_outputs(spark, d):
    """Turns of a conversation joined in order, with address and commitment."""
    whole = exchange.stitch(_turns(spark, d))
    payload = F.col("payload")
    return whole.select("task", F.length("payload").cast("bigint").alias("bytes"), scalars.content_address(payload).alias("address"), scalars.commitment_of_one(payload).alias("commitment"))


def _turns(spark, d):
    return T.table(spark, d, "conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("place"), F.col("text").cast("binary").alias("payload"))


def _stitch_parts(spark, d):
    turns = _turns(spark, d)
    payload, task = F.col("payload"), F.col("task")
    inputs = turns.select("task", "place", scalars.content_address(payload).alias("output"), F.when((task % 7 == 3) & (F.col("place") == 1), F.lit("0" * 64)).otherwise(scalars.commitment_of_one(payload)).alias("commitment"))
    inputs = inputs.withColumn("output", F.when((task % 5 == 1) & (F.col("place") == 1), "gone").otherwise(F.col("output")))
    whole = exchange.stitch(turns)
    requests = whole.select("task", F.when(task % 11 == 2, "gone").otherwise(scalars.content_address(payload)).alias("output"), F.when(task % 6 == 4, F.lit("0" * 64)).otherwise(scalars.commitment_of_one(payload)).alias("commitment"))
    blobs = turns.select("payload").union(whole.select("payload")).select(scalars.content_address(payload).alias("address"), "payload").dropDuplicates(["address"])
    return requests, inputs, blobs


_STITCHED = f"""{_TURNS}, {_WHOLE},
own AS (SELECT task, CASE WHEN task % 11 = 2 THEN 'gone' ELSE {_ADDRESS.format('whole')} END AS output, CASE WHEN task % 6 = 4 THEN repeat('0', 64) ELSE {_COMMITMENT.format('whole')} END AS commitment FROM w),
ins AS (SELECT task, CASE WHEN task % 5 = 1 AND place = 1 THEN 'gone' ELSE a END AS output, CASE WHEN task % 7 = 3 AND place = 1 THEN repeat('0', 64) ELSE c END AS commitment FROM i),
stored AS (SELECT DISTINCT {_ADDRESS.format('text')} AS address, {_COMMITMENT.format('text')} AS held FROM (SELECT text FROM i UNION ALL SELECT whole FROM w)),
parts AS (SELECT ins.task, bool_or(stored.held IS NULL) AS absent, bool_and(coalesce(stored.held = ins.commitment, false)) AS sound FROM ins LEFT JOIN stored ON stored.address = ins.output GROUP BY ins.task),
stitched AS (SELECT own.task, CASE WHEN stored.held IS NULL THEN 'Inconclusive' WHEN stored.held <> own.commitment THEN 'CommitmentMismatch' WHEN absent THEN 'Inconclusive' WHEN NOT sound THEN 'IntegrityViolation' ELSE 'Ok' END AS detail
 FROM own LEFT JOIN stored ON stored.address = own.output LEFT JOIN parts ON parts.task = own.task)"""


@query(f"WITH {_STITCHED} SELECT task, detail FROM stitched")
def stitch_verdicts(spark, d):
    """Stitched outputs checked: own output first, then each input; some outputs and inputs are gone or changed."""
    return exchange.verify_stitches(*_stitch_parts(spark, d))


@query(f"""{_VERDICTS}, {_STITCHED}, asked AS (SELECT DISTINCT conv_id AS task, CASE WHEN conv_id % 2 = 0 THEN 'stitch' ELSE 'transcode' END AS kind FROM conversations)
SELECT asked.task, asked.kind, coalesce(CASE WHEN asked.kind = 'stitch' THEN stitched.detail ELSE scored.detail END, 'Inconclusive') AS detail, coalesce(CASE WHEN asked.kind = 'stitch' THEN stitched.detail ELSE scored.detail END, '') = 'Ok' AS passed
FROM asked LEFT JOIN stitched ON stitched.task = asked.task LEFT JOIN scored ON scored.segment = asked.task""")
def verify_requests(spark, d):
    """Requests answered by the verdict of their kind: scored frames of the segment of that number, or a checked stitch; those without one are inconclusive."""
    asked = T.table(spark, d, "conversations").select(F.col("conv_id").alias("task")).distinct().withColumn("kind", F.when(F.col("task") % 2 == 0, "stitch").otherwise("transcode"))
    scored = verdicts(spark, d).select(F.col("segment").alias("task"), "detail")
    return exchange.verify_requests(asked, scored, stitch_verdicts(spark, d))


@query("WITH g AS (SELECT doc_id AS job, unnest(range(0, (length(text) - 1) // 500 + 1)) AS segment, text FROM documents WHERE length(text) > 0) SELECT job, segment, strlen(substr(text, segment * 500 + 1, 500))::BIGINT AS plain_bytes, (28 + strlen(substr(text, segment * 500 + 1, 500)))::BIGINT AS sealed_bytes, substr(sha256(substr(text, segment * 500 + 1, 500)), 1, 32) AS opened FROM g")
def staged_segments(spark, d):
    """Documents cut into segments of 500 characters, sealed under a key of their own, and the address of what opening gives."""
    docs = _documents(spark, d).where("length(text) > 0").select(F.col("doc_id").alias("job"), "text")
    places = docs.select("job", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.char_length("text") - 1) / 500).cast("bigint"))).alias("segment"))
    keys = places.withColumn("key", F.unhex(F.sha2(F.concat_ws("-", "job", "segment").cast("binary"), 256)))
    staged = exchange.stage(docs, 500, keys).join(keys, ["job", "segment"])
    opened = scalars.unseal(F.col("sealed"), F.col("key"), scalars.associated_data(F.col("job"), F.col("segment"), F.lit(0)))
    return staged.select("job", "segment", F.length(F.col("plain").cast("binary")).cast("bigint").alias("plain_bytes"), F.length("sealed").cast("bigint").alias("sealed_bytes"), scalars.content_address(opened).alias("opened"))


@query("WITH p AS (SELECT conv_id AS job, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT job, n, row_number() OVER (ORDER BY job) - 1 AS c, count(*) OVER () AS m FROM p), k AS (SELECT a.job, unnest(range(a.n)) AS segment, b.job AS other_job, b.n AS size FROM r a JOIN r b ON b.c = (a.c + 1) % a.m) SELECT job, segment, other_job, least(segment, size - 1) AS other_segment FROM k")
def attack_substitutes(spark, d):
    """Each piece with the one that an attacker would send instead: of the next job, at the same place or its last."""
    counts = T.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("job")).agg(F.count("*").alias("n"))
    pieces = counts.select("job", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("segment"))
    return exchange.substitutes(pieces, in_order(counts.select("job"), "job").select("job", "place"))


# Scalars ------------------------------------------------------------------------------------------------------------------------------
@query("SELECT vec_id, label, CASE label % 4 WHEN 0 THEN 'libx264' WHEN 1 THEN 'libx265' WHEN 2 THEN 'libsvtav1' ELSE 'libvpx-vp9' END AS encoder, CASE (vec_id // 4) % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' WHEN 2 THEN 'matroska' ELSE 'mpegts' END AS muxer FROM embeddings")
def profile_names(spark, d):
    """Encoder and muxer names of target profiles."""
    rows = T.table(spark, d, "embeddings")
    pick = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (k % 4 + 1).cast("int"))
    codec, container = pick(F.col("label"), list(scalars.ENCODERS)), pick(F.floor(F.col("vec_id") / 4), list(scalars.MUXERS))
    return rows.select("vec_id", "label", scalars.encoder_of(codec).alias("encoder"), scalars.muxer_of(container).alias("muxer"))


@formula("SELECT * FROM (VALUES ('cheap_downscale', 'FidelityBelowThreshold'), ('byte_swap', 'CommitmentMismatch'), ('wrong_content', 'FidelityBelowThreshold')) t(label, detail)")
def attack_verdicts(spark, d):
    """What a caught attack of each class is called."""
    rows = spark.createDataFrame([("cheap_downscale",), ("byte_swap",), ("wrong_content",)], "label string")
    return rows.select("label", scalars.catch_detail(F.col("label")).alias("detail"))


@query("SELECT doc_id, (SELECT sum(('0x' || h[2 * k + 1:2 * k + 2])::HUGEINT << (8 * k)) FROM range(8) r(k))::UHUGEINT::VARCHAR AS seed FROM (SELECT doc_id, sha256(unhex(sha256(text)) || unhex(lower(printf('%02x', doc_id & 255) || printf('%02x', (doc_id >> 8) & 255) || printf('%02x', (doc_id >> 16) & 255)) || repeat('00', 13))) AS h FROM documents)")
def challenge_seeds(spark, d):
    """Unsigned seeds from a commitment (here the hash of the text) and a number (here the id)."""
    return _documents(spark, d).select("doc_id", scalars.challenge_seed(F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id")).alias("seed"))


@formula("SELECT w, round(w * 1.0 + 0.15, 6)::DOUBLE AS first, round(w * 1.0 + 0.55, 6)::DOUBLE AS second FROM range(4) t(w)")
def window_times(spark, d):
    times = scalars.window_times(F.col("id"))
    return spark.range(4).select(F.col("id").alias("w"), F.round(F.get(times, F.lit(0)), 6).alias("first"), F.round(F.get(times, F.lit(1)), 6).alias("second"))


@query(f"WITH RECURSIVE {FOLD}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY task ORDER BY rn DESC) = 1) SELECT task, lower(status) AS state, CASE WHEN status IN ('Leased', 'Submitted', 'Verifying') THEN holder END AS holder_of FROM l")
def state_names(spark, d):
    """Stored names of states, and the holder where the state has one."""
    states = lifecycle.final_states(T.derived(spark, d, T.TASK_EVENTS))
    names = reputation.pick(F.col("status"), {v: k for k, v in exchange.STATUSES.items()})
    return states.select("task", names.alias("state"), F.when(F.col("status").isin("Leased", "Submitted", "Verifying"), F.col("holder")).alias("holder_of"))
