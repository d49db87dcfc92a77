"""Results beside brute force where hashes, chunk borders and formulas could mislead."""

import cmath
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import blocks, decontam, lm, media, minhash, mixing, quality, suffix, toxicity, urls, warc

from .test_text_operators import brute_hits, classes, ordered, repeated, words


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


@pytest.fixture(scope="module", params=[16, 64, 1024, 2048])
def twins(request):
    """Two words that polynomial hashes modulo a power of two don't tell apart."""
    return thue_morse(request.param)


def test_twin_words_are_no_near_copies(spark, twins):
    rows = [(1, twins[0]), (2, twins[1]), (3, twins[0])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert ordered(got.collect()) == ordered(classes(rows)) and got.where("component_id = 2").count() == 1


def test_twin_words_are_no_contamination(spark, twins):
    rows, items = [(1, f"x {twins[0]} y"), (2, twins[1])], [(5, twins[1])]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(got.collect()) == ordered([(i, *brute_hits(t, items)) for i, t in rows])


def test_twin_words_are_counted_apart(spark, twins):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, twins[1]), (held + 1, twins[0])]
    got = {r.doc_id: r for r in lm.likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held].n_known == 1 and got[held + 1].n_known == 2


def test_distinct_spans_survive_colliding_hashes(monkeypatch):
    data = np.frombuffer(b"ab ab cd ab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    monkeypatch.setattr(blocks, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    first, back = blocks.distinct_spans(data, starts, ends)
    assert blocks.spelled(data, starts[first], ends[first]) == [b"ab", b"cd"] and back.tolist() == [0, 0, 1, 0]


def test_texts_beyond_a_chunk(spark):
    """Texts over blocks.CHUNK, with copies of passages inside and across them."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    long, other = say(230_000), say(40)
    assert len(long) > blocks.CHUNK
    rows = [(1, long), (2, f"{other} {long[700_000:700_400]} {say(30)}"), (3, f"{long[:300]} {say(150_000)} {other}"), (4, long[:1000] + "zz" + long[1000:]), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(suffix.deduplicate(docs).drop("kept").collect()) == ordered(repeated(rows))
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert ordered(got.collect()) == ordered(classes(rows))
    item = " ".join(words(long)[100_000:100_012])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, bench).collect()}
    assert hits == {1: 12, 2: 0, 3: 0, 4: 12, 5: 0}


def test_merged_order_and_shared_bytes():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 99, 400).astype(np.uint8)
    parts = [[base[:180], base[30:230]], [base[100:400], rng.integers(97, 99, 150).astype(np.uint8)]]
    flat, transforms, at = [p for ps in parts for p in ps], [], 0
    gap = np.zeros(suffix.STEP, np.uint8)
    for ps in parts:
        own = suffix.Layout(np.concatenate([x for p in ps for x in (p, gap)]), np.array([len(p) + suffix.STEP for p in ps]))
        turned, start = suffix.transform(own, np.zeros(len(ps), np.int64))
        text, orders = suffix.restore([turned], start, own.sizes, np.array([len(ps)]))
        assert (text == own.text).all() and (orders[0] == suffix.cyclic_order(own)).all()
        transforms.append(orders[0] + at)
        at += len(own.text)
    laid = suffix.Layout(np.concatenate([x for p in flat for x in (p, gap)]), np.array([len(p) + suffix.STEP for p in flat]))
    positions, shared = suffix.intervals(laid, transforms)
    strings = [laid.text[p : p + suffix.SIZE].tobytes() for p in positions]
    assert strings == sorted(strings)
    for a, b, s in zip(strings[:-1], strings[1:], shared[1:], strict=True):
        common = next((k for k in range(suffix.SIZE) if a[k] != b[k]), suffix.SIZE)
        assert s == max(c for c in (0, 16, 32, 64, 100) if c <= common)


def test_transform_of_whole_periods_is_undone():
    text = np.frombuffer(b"ab\0\0ab\0\0" * 3 + b"ba\0\0ba\0\0" + b"x" * 30 + b"\0\0", np.uint8)
    sizes = np.array([24, 8, 32])
    turned, start = suffix.transform(suffix.Layout(text, sizes), np.array([0, 0, 1]))
    back, orders = suffix.restore([turned[:32], turned[32:]], start, sizes, np.array([2, 1]))
    assert (back == text).all() and [sorted(o) for o in orders] == [list(range(32)), list(range(32, 64))]


def plain_fingerprint(payload):
    n = len(payload)
    starts = list(range(0, n - 255, 128))
    if starts[-1] != n - 256:
        starts.append(n - 256)
    window = np.hanning(256)
    peaks = []
    for s in starts:
        frame = [payload[s + k] for k in range(256)]
        mean = sum(frame) / 256
        energy = [abs(sum((frame[k] - mean) * window[k] * cmath.exp(-2j * math.pi * b * k / 256) for k in range(256))) ** 2 for b in range(1, 129)]
        best = max(range(128), key=lambda b: energy[b])
        peaks.append((energy[best], best + 1))
    found = [(k, b) for k, (e, b) in enumerate(peaks) if e > 1 and all(e >= peaks[j][0] for j in range(max(0, k - 2), min(len(peaks), k + 3)))]
    pairs = [(t, b << 40 | found[k + j][1] << 32 | found[k + j][0] - t) for k, (t, b) in enumerate(found) for j in range(1, 4) if k + j < len(found)]
    return sorted(pairs)


def test_fingerprints(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abc xyz\n") for _ in range(n))) for k, n in enumerate((0, 30, 570, 1000))]
    for r in media.features(media.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        raw = rows[r.doc_id][1].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert list(zip(r.times, r.codes, strict=True)) == plain_fingerprint(payload)
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == 44 + len(payload)


def test_fingerprint_sees_the_end_and_long_distances():
    samples = np.full(128 * 4000 + 320, 128, np.uint8)
    t = np.arange(300)
    samples[:300] = samples[-300:] = (128 + 100 * np.sin(2 * np.pi * 20 * t / 256)).astype(np.uint8)
    times, codes = media.pairs(*media.peaks(samples))
    assert max(codes & 0xFFFFFFFF) > 3990 and len(times)


def plain_schedule(weights, blocks_of):
    """Slot of each (source, block), chosen slot by slot among the released ones."""
    period, done, out = sum(weights.values()), dict.fromkeys(weights, 0), {}
    for slot in range(max(-(-b * period // weights[s]) for s, b in blocks_of.items()) + period):
        ready = [(math.ceil((done[s] + 1) * period / w), s) for s, w in weights.items() if done[s] * period // w <= slot]
        if ready:
            _, s = min(ready)
            out[s, done[s]] = slot
            done[s] += 1
    return out


def test_slots(spark):
    rng = random.Random(9)
    weights = {"a": 3, "b": 5, "c": 1}
    rows = [(k, rng.choice("aabbbc"), f"t{k}") for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, slot string"), weights, size=4).collect()
    by = defaultdict(list)
    for i, s, _ in rows:
        by[s].append(i)
    want = plain_schedule({f"s{s}": w for s, w in weights.items()}, {f"s{s}": -(-len(v) // 4) for s, v in by.items()})
    expected = {i: (want[f"s{s}", k // 4], k // 4, k % 4) for s, v in by.items() for k, i in enumerate(sorted(v, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()))}
    assert {r.doc_id: (r.slot, r.block, r.place) for r in got} == expected


def test_rows_of_one_id_are_placed_alike(spark):
    rows = [(1, "a", f"text {k % 3}") for k in range(30)]
    places = [sorted((r.text, r.slot, r.place) for r in mixing.mix(spark.createDataFrame(rows[::step], "doc_id long, source string, text string").repartition(n)).collect()) for step, n in ((1, 1), (-1, 5))]
    assert places[0] == places[1]


def plain_scores(sides, address):
    """Mean over characters of ln p_allow - ln p_block of one address, models counted from lists of (address, times)."""
    padded = lambda a: urls.BEGIN * (urls.ORDER - 1) + a + urls.END
    tables = []
    for known in sides:
        count = Counter()
        for a, n in known:
            for at in range(urls.ORDER - 1, len(padded(a))):
                for size in range(1, urls.ORDER + 1):
                    count[padded(a)[at - size + 1 : at + 1]] += n
        context = Counter()
        for g, n in count.items():
            context[len(g), g[:-1]] += n
        tables.append((count, context))
    total, text = 0, padded(address)
    for at in range(urls.ORDER - 1, len(text)):
        ln = []
        for count, context in tables:
            p = 1 / urls.SYMBOLS
            for size in range(1, urls.ORDER + 1):
                g = text[at - size + 1 : at + 1]
                p = (count[g] + urls.MASS * p) / (context[size, g[:-1]] + urls.MASS)
            ln.append(math.log(p))
        total += round((ln[0] - ln[1]) * 1e6)
    return round(total / (len(text) - urls.ORDER + 1) / 1000)


def test_url_model(spark):
    rng = random.Random(12)
    part = lambda: "".join(rng.choice("abc😀e1") for _ in range(rng.randint(1, 6)))
    sites = [("a.com", "/en/"), ("example.com", "/en/7"), ("x.net", "/de/"), ("example.net", "/de/8"), ("b.org", "/es/"), ("c.io", "/"), ("net", "/de/")]
    rows = [(k, "https://{}{}{}".format(*(s := rng.choice(sites)), part())) for k in range(120)] + [(k, None) for k in (500, 501)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    action = {"net/de/": "allow", "example.com/en/7": "allow"}
    times = Counter((r.host, r.path, r.rule) for r in got)
    left_out = lambda h, p: int(hashlib.md5(f"{h}\x01{p}".encode()).hexdigest()[:4], 16) % urls.FOLD == 0
    sides = {"allow": [], "block": []}
    for (host, path, rule), n in times.items():
        if rule and not left_out(host, path):
            sides[action.get(rule, "block")].append((host + path, n))
    assert all(sides.values())
    want = {(h, p): plain_scores((sides["allow"], sides["block"]), h + p) for h, p, _ in times}
    assert {(r.host, r.path): r.score for r in got} == want
    held = [(want[h, p], action.get(rule, "block"), n) for (h, p, rule), n in times.items() if rule and left_out(h, p)]
    n_allow, n_block = (sum(n for _, a, n in held if a == side) for side in ("allow", "block"))
    rate = lambda cut: sum(n for s, a, n in held if a == "allow" and s >= cut) / n_allow + sum(n for s, a, n in held if a == "block" and s < cut) / n_block
    judged = [(r.score, r.verdict) for r in got if r.rule is None]
    cut_above, cut_below = max((s for s, v in judged if v == "block"), default=-10**9), min((s for s, v in judged if v == "allow"), default=10**9)
    assert cut_above < cut_below
    if n_allow and n_block:
        top = max(rate(c) for c in {s for s, _, _ in held} | {10**9})
        assert any(abs(rate(c) - top) < 1e-12 for c in range(max(cut_above, -3000) + 1, min(cut_below, 3000) + 1))


def test_very_long_urls(spark):
    rows = [(1, "http://a.com/en/" + "x" * 100_000), (2, "http://net/de/" + "ab" * 50_000), (3, "http://b.io/?" + "q" * 100_000), (4, "y" * 100_000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].rule, got[2].verdict, got[3].path, got[4].host) == ("com/en/", "allow", "/", "") and len(got[1].path) == 100_004


def segmentations(word, share):
    """All ways to cut word into pieces of share."""
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in share:
            for rest in segmentations(word[k:], share):
                yield (word[:k], *rest)


@pytest.mark.parametrize("rounds", [0, 1])
def test_lattice_score_of_documents(spark, rounds):
    rows = [(k, t) for k, t in enumerate(["ab ba", "the Cat's naïve", "", "ab " * 5, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = lm.load_pieces()
    share = dict(zip(pieces.spans, np.exp(pieces.log).tolist(), strict=True))

    def lattice(word):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            sums[end] = sum(sums[at] * share.get(word[at:end], 0.0) for at in range(end))
        return sums[-1]

    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i, t in rows if i not in held for w in words(t))
    ends = len(rows) - len(held)
    total, types = sum(count.values()) + ends, len(count) + 1
    for _ in range(rounds):  # expected uses by enumeration of all segmentations
        used = Counter()
        for word, n in count.items():
            weights = Counter()
            for parts in segmentations(b" " + word.encode(), share):
                weights[parts] = math.prod(share[x] for x in parts)
            for parts, weight in weights.items():
                for x in parts:
                    used[x] += n * weight / sum(weights.values())
        share = {x: (1 - lm.KEEP) * used[x] / sum(used.values()) + lm.KEEP * v for x, v in share.items()}
    for r in lm.likelihood(docs, rounds=rounds).collect():
        pure = [lattice(b" " + w.encode()) for w in words(rows[r.doc_id][1])]
        last = math.log10((ends - lm.DISCOUNT) / total)
        seen = [max(count[w] - lm.DISCOUNT, 0) / total for w in words(rows[r.doc_id][1])]
        assert math.isclose(r.lattice_score, sum(map(math.log10, pure)) + last, rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(s + lm.DISCOUNT * types / total * p) for s, p in zip(seen, pure, strict=True)) + last, rel_tol=1e-9)


def test_posteriors_document_by_document():
    """EM over counts of patterns gives what EM over single documents gives."""
    rng = np.random.default_rng(5)
    table = rng.integers(0, 3, (300, 4))
    patterns, back, n = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    post, accuracy = quality.estimate(patterns, n.astype(float))
    single, again = quality.estimate(table, np.ones(300))
    assert np.allclose(post[back], single) and np.allclose(accuracy, again)


def test_leads_and_labeller_table(spark, odd):
    model = quality.fit(odd)
    table = {r.labeller: r for r in quality.labeller_accuracy(spark, model).collect()}
    assert set(table) == set(quality.LABELLERS) and all(0 <= r.accuracy <= 1 and 0 <= r.coverage <= 1 for r in table.values())
    for lead, votes in zip(model.leads(), model.patterns, strict=True):
        cast = [name for name, v in zip(quality.LABELLERS, votes, strict=True) if v != quality.ABSTAIN]
        assert lead is None and not cast or table[lead].accuracy == max(table[c].accuracy for c in cast)


def test_toxicity_votes(spark):
    """Scores and evidence beside dense vectors over the index's terms."""
    rng = random.Random(7)
    say = lambda n, extra=(): " ".join(rng.choice([*(f"w{k}" for k in range(40)), *extra]) for _ in range(n))
    rows = [(k, say(30, ("vile", "awful", "rotten") * 6 if k % 3 == 0 else ())) for k in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert len(index.terms)
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        span = slice(index.bounds[t], index.bounds[t + 1])
        dense[index.example[span], t] = index.weight[span]
    text = dict(rows)
    for r in toxicity.score(docs, index).collect():
        found = Counter(int(h) for w in re.findall(r"[a-z0-9]+", text[r.doc_id]) for h in _hashes(w))
        v = np.array([(1 + math.log(found[int(t)])) * i if found[int(t)] else 0.0 for t, i in zip(index.terms, index.idf, strict=True)])
        if not v.any():
            assert r.score == index.rate and not r.evidence
            continue
        cos = dense @ (v / np.linalg.norm(v))
        best = sorted(range(len(cos)), key=lambda k: (-round(cos[k], 12), k))[: toxicity.NEAREST]
        best = [k for k in best if cos[k] > 0]
        assert np.allclose(r.cosines, cos[best]) and list(r.evidence) == [index.ids[k] for k in best]
        votes = cos[best] * index.mass[best]
        prior = toxicity.PRIOR_WEIGHT * index.mass.min()
        assert math.isclose(r.score, (votes @ index.label[best] + prior * index.rate) / (votes.sum() + prior))


def _hashes(word):
    data = np.frombuffer(word.encode(), np.uint8)
    with np.errstate(over="ignore"):
        whole, _, stems, _ = toxicity.term_hashes(data, np.array([0, len(data)]))
    return [*whole, *stems]


def test_appends_and_overwrites_of_archives(spark, tmp_path):
    one, two = (spark.createDataFrame([(k, "http://a.b/", t)], "page_id long, url string, html string") for k, t in ((1, "x" * 200), (2, "y")))
    path = f"file://{tmp_path}/a"
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    warc.archive(one, path)
    warc.archive(two, path)
    warc.archive(one, path)
    assert ids() == ["<urn:page:1>", "<urn:page:1>", "<urn:page:2>"]
    warc.archive(two, path, mode="overwrite")
    assert ids() == ["<urn:page:2>"] and len(list((tmp_path / "a").iterdir())) == 2


def test_proximity_of_rows_without_an_id(spark):
    index = decontam.build_index(spark.createDataFrame([(None, "One x two"), (4, "two one")], "doc_id long, text string"), None)
    near = decontam.proximity(index, "one", "two", 2).collect()
    assert ordered(near) == ordered([(None, 0, 2), (4, 1, 0)])
