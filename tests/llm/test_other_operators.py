"""Media, quality, toxicity, mixing, WARC and URL operators."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fathom.llm import media, mixing, quality, queries, toxicity, urls, warc

LARGER = "/root/testdata/sf0.01"


def test_media_round_trip(odd, odd_rows):
    stored = {(r.doc_id, r.n_bytes, bytes(r.media)) for r in media.encode(odd).collect()}
    want = set()
    for i, t in odd_rows:
        raw = (t or "").encode()
        want.add((i, len(raw), raw + b"\xff" * (max(576, math.ceil(len(raw) / 576) * 576) - len(raw))))
    assert {(i, n, media.from_wav(m)) for i, n, m in stored} == want
    rows = media.features(media.encode(odd)).collect()
    assert len(rows) == len(odd_rows)
    payloads = {(i, n): p for i, n, p in want}
    for r in rows:
        p = payloads[r.doc_id, r.n_bytes]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(r.times) == len(r.codes) and list(r.times) == sorted(r.times)


def test_peaks_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / media.SIZE) * (1 + 0.2 * np.sin(t / 900))).astype(np.uint8)
    _, bins = media.peaks(tone)
    assert set(bins) == {20}
    assert len(media.peaks(np.full(2000, 128, np.uint8))[0]) == 0


def test_media_of_nothing(nothing):
    assert media.features(media.encode(nothing)).isEmpty()


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    vote = lambda p: np.where(rng.random(len(truth)) < p, truth, ~truth) + 1
    table = np.stack([vote(0.97), vote(0.95), vote(0.75)], axis=1)
    patterns, n = np.unique(table, axis=0, return_counts=True)
    post, accuracy = quality.estimate(patterns, n.astype(float))
    assert accuracy[0] > accuracy[2] and accuracy[1] > accuracy[2]
    assert post[(patterns == quality.GOOD).all(axis=1)][0] > 0.9 > post[(patterns == quality.BAD).all(axis=1)][0]


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    joined = quality.assess(docs).join(labels, "doc_id").where("quality is not null")
    right, n = joined.selectExpr("count_if(keep = (quality = 1))", "count(*)").first()
    assert right / n >= 0.85


def test_quality_of_odd_rows(odd, odd_rows, nothing):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.weak <= 1 and 0 <= r.score <= 1 for r in rows)
    assert quality.assess(nothing).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    scored = queries.op5_toxicity(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    # 37 toxic rows to learn from: 9 of 14 held-out ones are found; with nine times the rows, 91 of 120.
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.6
    assert sum(r.predicted for r in clean) / len(clean) <= 0.02


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    n, terms = 400, np.sort(rng.choice(2**40, 50, replace=False).astype(np.uint64))
    label = (np.arange(n) % 3 == 0).astype(np.int64)
    whole = [rng.choice(terms[:30] if y else terms[10:], rng.integers(1, 20)) for y in label]
    none = [np.zeros(0, np.uint64)] * n
    index = toxicity.build(whole, none, np.ones(n), label, np.ones(n), np.arange(n), label.mean())
    assert len(index.terms)
    dense = np.zeros((n, len(index.terms)))
    for k in range(n):
        at, w = index.vector(whole[k], none[k])
        dense[k, at] = w
    for k in range(0, n, 7):
        at, w = index.vector(whole[k], none[k])
        cosines = np.sort((dense @ dense[k])[dense @ dense[k] > 1e-12])[::-1][: toxicity.NEAREST]
        assert np.allclose(index.nearest(at, w)[1], cosines)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, 0), (4, 0), (22, 1), (10**9, 1), (25, None)], "doc_id long, toxic int")
    index = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, index).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing, index).isEmpty()
    bare = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, bare).collect()} == {0.0}
    assert toxicity.reject(odd, bare).count() == len(odd_rows)


def test_schedule_stays_within_a_block():
    weights = {"a": 5, "b": 3, "c": 1, "d": 7}
    period, run = sum(weights.values()), dict.fromkeys(weights, 0)
    rows = mixing.schedule(weights)
    assert sorted(r[2] for r in rows) == list(range(period))
    for name, _, slot, release, deadline in sorted(rows, key=lambda r: r[2]):
        assert release <= slot < deadline
        run[name] += 1
        assert all(abs(run[s] - Fraction(w * (slot + 1), period)) < 1 for s, w in weights.items())
    with pytest.raises(ValueError):
        mixing.schedule({"a": 0})


def test_mix_keeps_every_row(odd, odd_rows, nothing):
    weights = {None: 2, "s0": 1, "s1": 3, "s2": 1}
    rows = mixing.mix(odd, weights, size=2).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, odd_rows))
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in by_slot.values())
    assert mixing.mix(nothing, weights).isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(odd, {"s0": 1})


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "same body " * 20
    rows = [(5, "https://a.example.com/en/7/x?q=1", body), (2, None, body), (2, None, body), (9, "no scheme", None), (None, "http://B.net/de/", body), (7, "http://x.org/es/1", ""), (8, "ftp://Y.ORG?e", "short"), (11, "http://y.org#f/es/", "short"), (12, "http://notexample.com/en/9", "ü" * 80), (13, "http://example.net/de/8", "ü" * 80), (14, "http://h.io/é x\n", "z" * 300000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, rule int, host string")


def test_warc(spark, pages):
    rows = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    assert len(rows) == 11
    kinds = {(r[0], r[3], r[4]) for r in rows}
    assert kinds == {(5, "revisit", 2), (2, "response", None), (9, "response", None), (None, "revisit", 2), (7, "response", None), (8, "response", None), (11, "response", None), (12, "response", None), (13, "revisit", 12), (14, "response", None)}
    assert all(r[1] == 160 for r in rows if r[0] in (12, 13))
    assert warc.round_trip(pages.limit(0)).isEmpty()


def test_warc_pushdown(spark, pages, tmp_path):
    warc.archive(pages, f"file://{tmp_path}/a")
    found = warc.read_warc(spark, f"file://{tmp_path}/a")
    assert {r.payload_length for r in found.where("record_type = 'response' and payload_digest = '%s'" % hashlib.sha256(b"short").hexdigest()).collect()} == {5}
    headers = warc.read_warc(spark, f"file://{tmp_path}/a", payload=False)
    assert headers.count() == 11 and headers.where("payload is not null").isEmpty()
    reader = warc.WarcReader({"path": f"file://{tmp_path}/a"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert left == [GreaterThan(("payload_length",), 3)]
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"revisit"}


def expected_rule(url):
    head, cut, rest = (url or "").partition("://")
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    if not cut:
        host = path = ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark, pages):
    for df in (pages.select("page_id", "url", "html"), spark.read.parquet(f"{LARGER}/pages.parquet").select("page_id", "url")):
        sent = {}
        for r in df.collect():
            sent.setdefault(r.page_id, set()).add(expected_rule(r.url))
        rows = urls.judge(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            action = [e for e in sent[r.page_id] if e[:3] == (r.host, r.path, r.rule)]
            assert action and r.verdict in ((action[0][3],) if action[0][3] else ("allow", "block"))
    assert urls.judge(pages.limit(0)).isEmpty()


def test_url_plan_has_no_python(spark):
    plan = urls.judge(spark.read.parquet(f"{LARGER}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_store_names():
    named = {"s3a://bucket/a b/c": "s3://bucket/a b/c", "s3n://bucket": "s3://bucket", "abfss://box@account/x": "abfs://box@account/x", "file:///tmp/x": "file:///tmp/x", "/tmp/x": "/tmp/x", "hdfs://name:8020/x": "hdfs://name:8020/x"}
    assert {path: warc.store_uri(path) for path in named} == named
