"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_list, decontam, lm, media, minhash, mixing, quality, ranked, spelling, suffix, toxicity, urls, warc
from .scratch import store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    media_table = store(media.encode(_table(spark, sf_dir, "documents")), "media", "zstd")
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.sha2(F.concat_ws(",", F.array_join("times", ","), F.array_join("codes", ",")), 256))
    return media.features(media_table).withColumn("feature", feature)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, index)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence", "cosines")


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.likelihood(_table(spark, sf_dir, "documents"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.target_weights(docs)).select("doc_id", "source", "block", "place", "release", "deadline", "slot", "balanced")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(_table(spark, sf_dir, "documents")).drop("kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decision_list.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_fingerprints, op2_minhash_near_dedup, op3_quality_classifier, op4_benchmark_decontamination, op5_toxicity, op6_lattice_likelihood, op7_pfair_mixing, op8_warc_round_trip, op9_url_filter, op10_suffix_dedup, op11_ranked_search, op12_spelling_variants, op13_quality_rules)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _url_sql() -> str:
    """Rules by a relation, models by counts of suffixes of five characters, the cut-off by running sums."""
    orders = range(1, 6)
    tables = ", ".join(f"s{n} AS (SELECT right(g, {n}) AS g, sum(a) AS a, sum(b) AS b FROM known GROUP BY 1), c{n} AS (SELECT left(g, {n - 1}) AS g, sum(a) AS a, sum(b) AS b FROM s{n} GROUP BY 1)" for n in orders)
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.g = right(d.g, {n}) LEFT JOIN c{n} ON c{n}.g = left(right(d.g, {n}), {n - 1})" for n in orders)
    chance = {"a": "(1.0::DOUBLE / 128)", "b": "(1.0::DOUBLE / 128)"}
    for n in orders:
        chance = {x: f"((coalesce(s{n}.{x}, 0)::DOUBLE + 4.0::DOUBLE * {p}) / (coalesce(c{n}.{x}, 0)::DOUBLE + 4.0::DOUBLE))" for x, p in chance.items()}
    return rf"""
WITH rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id, instr(coalesce(url, ''), '://') AS pos, substr(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3) AS rest FROM pages),
u AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
a AS (SELECT host, path, count(*) AS n FROM u GROUP BY ALL),
best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM a JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
j AS (SELECT a.host, a.path, n, rule, action, ('0x' || left(md5(a.host || chr(1) || a.path), 4))::INT % 5 = 0 AS held, repeat(chr(2), 4) || a.host || a.path || chr(3) AS t FROM a LEFT JOIN best ON best.host = a.host AND best.path = a.path),
g AS (SELECT host, path, n, action, held, substr(t, i, 5) AS g FROM (SELECT *, unnest(range(1, length(t) - 3)) AS i FROM j)),
known AS (SELECT g, sum(CASE WHEN action = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN action = 'block' THEN n ELSE 0 END) AS b FROM g WHERE action IS NOT NULL AND NOT held GROUP BY g),
{tables},
scores AS (SELECT d.g, round((ln({chance['a']}) - ln({chance['b']})) * 1e6)::BIGINT AS score FROM (SELECT DISTINCT g FROM g) d {joins}),
m AS (SELECT host, path, round(sum(score)::BIGINT / count(*) / 1000.0::DOUBLE)::BIGINT AS milli FROM g JOIN scores ON scores.g = g.g GROUP BY host, path),
v AS (SELECT milli, coalesce(sum(n) FILTER (action = 'allow'), 0) AS a, coalesce(sum(n) FILTER (action = 'block'), 0) AS b FROM j JOIN m ON m.host = j.host AND m.path = j.path WHERE held AND action IS NOT NULL GROUP BY milli),
k AS (SELECT milli, coalesce(lag(milli) OVER (ORDER BY milli), milli) AS low, coalesce(sum(a) OVER (ORDER BY milli ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ua, coalesce(sum(b) OVER (ORDER BY milli ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ub, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v),
best_cut AS (SELECT arg_max(cut, (gain, cut)) AS cut FROM (SELECT (ta - ua)::DOUBLE / ta::DOUBLE + ub::DOUBLE / tb::DOUBLE AS gain, floor((low + milli) / 2.0)::BIGINT + CASE WHEN low < milli THEN 1 ELSE 0 END AS cut FROM k WHERE ta > 0 AND tb > 0))
SELECT u.page_id, u.host, u.path, j.rule, coalesce(j.action, CASE WHEN m.milli >= coalesce((SELECT cut FROM best_cut), 0) THEN 'allow' ELSE 'block' END) AS verdict, m.milli AS score
FROM u JOIN j ON j.host = u.host AND j.path = u.path JOIN m ON m.host = u.host AND m.path = u.path"""


SQL: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(v, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.v),
m AS (SELECT v, min(label) AS label FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.label AS component_id, d.doc_id = m.label AS kept
FROM documents d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + 9], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM b)),
sizes AS (SELECT DISTINCT size FROM k),
g AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
      FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT doc_id, i, g.size, item_id FROM g JOIN k ON k.g = g.g AND k.size = g.size),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op8_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND p.n >= 100""",
    "op7_pfair_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s, 1 + CASE WHEN source IS NULL OR source = '' THEN 0 ELSE ('0x' || right(hex(encode(source)), 2))::INT % 4 END AS w FROM documents),
n AS (SELECT s, any_value(w) AS w, count(*) AS n FROM d GROUP BY s),
c AS (SELECT list(s ORDER BY s) AS s, list(w ORDER BY s) AS w, sum(w)::BIGINT AS p FROM n),
run(slot, k, i, j) AS (SELECT -1::BIGINT, list_transform(s, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM c
 UNION ALL SELECT slot + 1, list_transform(range(1, len(k) + 1), lambda q: CASE WHEN q = pick THEN k[q] + 1 ELSE k[q] END), pick, k[pick]
 FROM (SELECT slot, k, list_sort(list_filter(list_transform(range(1, len(k) + 1), lambda q: struct_pack(due := ((k[q] + 1) * p + w[q] - 1) // w[q], q := q, released := k[q] * p // w[q], left_over := w[q] - k[q])), lambda x: x.released <= slot + 1 AND x.left_over > 0))[1].q AS pick
       FROM run, c WHERE slot + 1 < p)),
t AS (SELECT c.s[i] AS s, c.w[i] AS w, j, slot, j * p // c.w[i] AS released, ((j + 1) * p + c.w[i] - 1) // c.w[i] AS due, p FROM run, c WHERE slot >= 0),
gap AS (SELECT min((n // 8) // n.w * p + slot) AS slot FROM n JOIN t ON t.s = n.s AND t.j = (n // 8) % n.w),
r AS (SELECT doc_id, source, d.s, row_number() OVER (PARTITION BY d.s ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM d)
SELECT doc_id, source, k // 8 AS block, k % 8 AS place, k // 8 // w * p + released AS release, k // 8 // w * p + due AS deadline, k // 8 // w * p + t.slot AS slot, k // 8 // w * p + t.slot < gap.slot AS balanced
FROM r JOIN t ON t.s = r.s AND t.j = (k // 8) % w, gap""",
    "op9_url_filter": _url_sql(),
    "op10_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS n, o, substr(h, o * 2 + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS o FROM d)),
s AS (SELECT doc_id, o + i AS p, md5_number(substr(part, (i * 2 + 1)::INT, 200)) AS g FROM (SELECT *, unnest(range(0, least(500, n - o - 99))) AS i FROM c)),
f AS (SELECT g, min((doc_id, p)) AS first FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, p, p > 100 + lag(p, 1, -101) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM s JOIN f ON f.g = s.g WHERE (doc_id, p) <> first),
k AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r) GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM k),
t AS (SELECT e.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(substr(h, before * 2 + 1, (a - before) * 2), '' ORDER BY a) AS lead FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(lead, '') || substr(h, coalesce(tail, 0) * 2 + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_ranked_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
r AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN f ON f.term = q.term JOIN p ON p.term = q.term, s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20""",
    "op12_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
k AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
gone AS (SELECT DISTINCT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS s FROM g),
star AS (SELECT word, n, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS s FROM g),
near AS (SELECT a.word AS word, b.word AS near, b.n AS m FROM star a JOIN star b ON a.s = b.s AND a.word <> b.word
 UNION SELECT gone.word, v.word, v.n FROM gone JOIN v ON v.word = gone.s
 UNION SELECT v.word, gone.word, gone.n FROM gone JOIN v ON v.word = gone.s),
best AS (SELECT word, count(*) AS n_near, min((-m, near)) AS top FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 5 * v.n THEN top[2] END AS form, CASE WHEN -top[1] >= 5 * v.n THEN -top[1] END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.tip WHERE f.form IS NOT NULL)
SELECT f.form, f.form_n::BIGINT AS form_n, f.n, f.n_near, tip AS root, f.word FROM f JOIN walk ON walk.word = f.word JOIN f AS last ON last.word = tip AND last.form IS NULL""",
}
