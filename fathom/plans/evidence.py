"""Registered queries of sampled evidence: frames out of binary planes, forged payloads and segments, exact detection, last releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reputation, scalars, udfs
from ..operators import analytics, exchange, planes, variants
from ..sources import tables as T
from ..sources.staged import store
from .catalog import query
from .registry import _MIX, _SSIM, _frame_pairs


@query(f"""{_SSIM}, {_MIX}, g AS (SELECT vec_id // 8 AS segment, count(*) AS n, min(vec_id) AS first FROM r GROUP BY 1),
o AS (SELECT segment, n, first, n * 64 - CASE WHEN segment % 11 = 3 THEN 5 WHEN segment % 17 = 5 THEN n * 64 ELSE 0 END AS size FROM g),
w AS (SELECT o.segment, min(r.ssim) AS worst FROM o JOIN m3 ON m3.segment = o.segment JOIN r ON r.vec_id = o.first + least(floor(fraction * n), n - 1)::BIGINT GROUP BY o.segment)
SELECT o.segment, CASE WHEN size > 0 AND size % 64 = 0 THEN size // 64 END AS frames, CASE WHEN size > 0 AND size % 64 = 0 THEN NULL ELSE 'FrameSize' END AS error, CASE WHEN size > 0 AND size % 64 = 0 THEN round(worst, 6) END AS worst
FROM o JOIN w ON w.segment = o.segment""")
def sampled_frames(spark, d):
    """Segments as binary planes, cut at three challenge positions each; some were sent short, some empty."""
    pairs = _frame_pairs(spark, d).select(F.expr("vec_id div 8").alias("segment"), "vec_id", planes.packed(F.col("a")).alias("a"), planes.packed(F.col("b")).alias("b"))
    whole = lambda c: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", F.hex(c).alias("bytes")))), lambda r: r["bytes"]), ""))
    segments = pairs.groupBy("segment").agg(whole("a").alias("sent"), whole("b").alias("reference"))
    short = F.when(F.col("segment") % 11 == 3, 5).when(F.col("segment") % 17 == 5, F.length("sent")).otherwise(0)
    segments = segments.withColumn("sent", F.substring("sent", F.lit(1), F.length("sent") - short)).withColumn("fractions", udfs.sample_fractions(3)("segment"))
    return planes.sampled_scores(segments, 8, 8).select("segment", F.col("frames").cast("bigint").alias("frames"), "error", F.round("worst", 6).alias("worst"))


@query(r"""WITH t AS (SELECT doc_id, lang, hex(encode(text)) AS h, strlen(text) AS n, ('0x' || left(md5(doc_id::VARCHAR), 7))::BIGINT AS draw FROM documents),
f AS (SELECT doc_id, lang, n, sha256('\x00'::BLOB || unhex(sha256(unhex(h)))) AS own, sha256('\x00'::BLOB || unhex(sha256(unhex(CASE WHEN n = 0 THEN h ELSE left(h, 2 * (draw % n)) || printf('%02X', xor(('0x' || substr(h, 2 * (draw % n) + 1, 2))::INT, 255)) || substr(h, 2 * (draw % n) + 3) END)))) AS held FROM t)
SELECT doc_id, lang, held, CASE WHEN own = held THEN 'Ok' ELSE 'CommitmentMismatch' END AS detail FROM f""")
def forged_bindings(spark, d):
    """Every document's payload with one byte turned, under the binding check against the commitment of the true one."""
    true = T.table(spark, d, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias("payload"), F.expr("cast(conv(left(md5(cast(doc_id as string)), 7), 16, 10) as bigint)").alias("draw"))
    sent = true.select("doc_id", "lang", F.col("doc_id").cast("string").alias("output"), scalars.commitment_of_one(F.col("payload")).alias("commitment"))
    blobs = true.select(F.col("doc_id").cast("string").alias("address"), planes.flipped(F.col("payload"), F.col("draw") % F.greatest(F.length("payload"), F.lit(1))).alias("payload"))
    held = exchange.bound(blobs).select(F.col("address").alias("output"), F.col("commitment").alias("held"))
    detail = F.when(F.col("held").isNull(), "Inconclusive").when(F.col("held") != F.col("commitment"), "CommitmentMismatch").otherwise("Ok")
    return sent.join(held, "output", "left").select("doc_id", "lang", "held", detail.alias("detail"))


@query(f"""WITH s AS ({T.SCORES}), r AS (SELECT stratum AS class, count(*) FILTER (class = 'attack' AND score >= 0.5) / count(*) FILTER (class = 'attack')::DOUBLE AS far FROM s GROUP BY stratum HAVING count(*) FILTER (class = 'attack') > 0),
j AS (SELECT source AS job, count(*) AS n, count(*) FILTER (toxic = 1) AS m FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source),
k AS (SELECT job, n, m, tier, least(n, ceil(p * n))::BIGINT AS k FROM j, (VALUES ('Watch', 0.10::DOUBLE), ('Suspect', 0.25::DOUBLE)) t(tier, p)),
e AS (SELECT class, job, tier, n, m, k, far, unnest(range(greatest(0, k - (n - m)), least(m, k) + 1)) AS i FROM k, r),
x AS (SELECT *, exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS mass FROM e)
SELECT class, job, tier, n, m, k, round(1 - sum(mass * far ** i), 6) + 0.0 AS p_exact, round((1 - sum(mass) FILTER (i = 0)) * (1 - any_value(far)), 6) + 0.0 AS p_product FROM x GROUP BY ALL""")
def exact_detection(spark, d):
    """Detection by class and job from measured rates: exactly, and as the product of drawing a tampered segment and catching one."""
    far = analytics.error_rates(T.derived(spark, d, T.SCORES), F.lit(0.5), "stratum").where("attacks > 0").select(F.col("stratum").alias("class"), "far")
    marked = T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("job")).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("m"))
    tiers = F.explode(F.array(*(F.struct(F.lit(name).alias("tier"), F.lit(p).alias("p")) for name, p in (("Watch", 0.10), ("Suspect", 0.25)))))
    drawn = marked.withColumn("t", tiers).select("job", "n", "m", "t.tier", reputation.challenge_count(F.col("t.p"), F.col("n")).alias("k"))
    rates = far.groupBy().agg(F.collect_list(F.struct("class", "far")).alias("rates"))  # one row of as many rates as there are classes
    each = drawn.crossJoin(F.broadcast(rates)).withColumn("r", F.explode("rates")).select("job", "n", "m", "tier", "k", "r.class", "r.far")
    exact = scalars.detect_exactly(F.col("n"), F.col("m"), F.col("k"), F.col("far"))
    product = scalars.detect_hypergeometric(F.col("n"), F.col("m"), F.col("k")) * (1 - F.col("far"))
    return each.select("class", "job", "tier", "n", "m", "k", (F.round(exact, 6) + 0.0).alias("p_exact"), (F.round(product, 6) + 0.0).alias("p_product"))


@query("SELECT substr(sha256(text), 1, 32) AS output, arg_max(doc_id, doc_id) AS task, arg_max(lang, doc_id) AS lang, count(*) AS writes FROM documents GROUP BY 1")
def last_releases(spark, d):
    """The release that stands at each output address: of several writes the last."""
    rows = T.table(spark, d, "documents").select(scalars.content_address(F.col("text").cast("binary")).alias("output"), F.col("doc_id").alias("task"), "lang")
    return rows.groupBy("output").agg(F.max("task").alias("task"), F.max_by("lang", "task").alias("lang"), F.count("*").alias("writes"))


#: Clips of 32 frames in four windows of eight, of which the third and the sixth are compared; an attacker has the next clip's frames.
_VARIANTS = """v AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings), q AS (SELECT vec_id, i, greatest(0, least(255, round((e::DOUBLE + 1) * 127.5)))::DOUBLE AS v FROM v), top AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
f AS (SELECT vec_id, i, v AS a FROM q WHERE vec_id % 8 IN (2, 5)),
b AS (SELECT vec_id, i, a, 'honest' AS variant, floor(a / 4) * 4 + 2 AS b FROM f
 UNION ALL SELECT vec_id, i, a, 'cheap_downscale', avg(a) OVER (PARTITION BY vec_id, i // 16, i % 8 // 2) FROM f
 UNION ALL SELECT vec_id, i, a, 'wrong_bitrate', floor(a / 64) * 64 + 32 FROM f
 UNION ALL SELECT f.vec_id, f.i, a, 'frame_substitution', q.v FROM f, top JOIN q ON q.vec_id = (f.vec_id + 32) % n AND q.i = f.i
 UNION ALL SELECT vec_id, i, a, 'garbage', 16 FROM f),
s AS (SELECT vec_id, variant, avg(a) AS mx, avg(b) AS my, var_samp(a) AS vx, var_samp(b) AS vy, covar_samp(a, b) AS c FROM b GROUP BY ALL),
x AS (SELECT vec_id // 32 AS clip, vec_id // 8 % 4 AS segment, variant, round(min(((2 * mx * my + 6.5025) * (2 * c + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))), 6) AS score FROM s GROUP BY ALL),
samples AS (SELECT clip, segment, CASE segment WHEN 0 THEN 'calibration' WHEN 1 THEN 'held_out' WHEN 2 THEN 'calibration' ELSE 'held_out' END AS set, variant, CASE variant WHEN 'honest' THEN 'honest' ELSE 'attack' END AS class, score FROM x)"""


def _variant_samples(spark, d):
    luma = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((e.cast("double") + 1) * 127.5))))
    frames = T.table(spark, d, "embeddings").select("vec_id", luma.alias("a"))
    total = frames.agg((F.max("vec_id") + 1).alias("total"))
    drawn = frames.where(F.expr("vec_id % 8 IN (2, 5)")).crossJoin(F.broadcast(total)).withColumn("other", F.expr("(vec_id + 32) % total"))  # one row
    paired = drawn.join(frames.select(F.col("vec_id").alias("other"), F.col("a").alias("substitute")), "other", "left")
    placed = paired.select(F.expr("vec_id div 32").alias("clip"), F.expr("vec_id div 8 % 4").alias("segment"), F.col("vec_id").alias("frame"), "a", "substitute")
    return variants.samples(placed, 8, 8).withColumn("score", F.round("score", 6))


@query(f"WITH {_VARIANTS} SELECT * FROM samples")
def variant_samples(spark, d):
    """Every segment of every clip as sent honestly and as forged in four ways, each by its least similarity."""
    return _variant_samples(spark, d)


@query(f"""WITH {_VARIANTS}, k AS (SELECT class, score FROM samples WHERE set = 'calibration'),
t AS (SELECT coalesce((score + lag(score) OVER (ORDER BY score)) / 2, score - 1e-6) AS t FROM (SELECT DISTINCT score FROM k) UNION ALL SELECT max(score) + 1e-6 FROM k),
j AS (SELECT t, round((1 - count(*) FILTER (class = 'honest' AND score < t)::DOUBLE / count(*) FILTER (class = 'honest')) - count(*) FILTER (class = 'attack' AND score >= t)::DOUBLE / count(*) FILTER (class = 'attack'), 9) AS j FROM t, k GROUP BY t),
cut AS (SELECT arg_max(t, (j, t)) AS t FROM j)
SELECT variant, class, round(t, 6) AS threshold, count(*) AS n, count(*) FILTER (score >= t) AS accepted, round(count(*) FILTER (score >= t) / count(*)::DOUBLE, 6) AS rate FROM samples, cut WHERE set = 'held_out' GROUP BY variant, class, t""")
def variant_rates(spark, d):
    """How much of each variant passes among held-out segments, at the threshold of the calibrating ones."""
    found = variants.rates(store(_variant_samples(spark, d), "variants"))
    return found.withColumns({"threshold": F.round("threshold", 6), "rate": F.round("rate", 6)})
