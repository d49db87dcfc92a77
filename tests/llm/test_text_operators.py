"""MinHash classes, decontamination, repeated bytes and language-model scores against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from fathom.llm import decontam, lm, minhash, suffix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """component per row, by trying every pair."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)]


def repeated(rows):
    """(doc_id, n_bytes, n_removed, n_spans, hash of what is left) per row, from a table of all 100-byte strings."""
    first = {}
    order = lambda i: -math.inf if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for at in range(len(b) - 99):
            first[b[at : at + 100]] = min(first.get(b[at : at + 100], (math.inf, 0)), (order(i), at))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - 99):
            if first[b[at : at + 100]] < (order(i), at):
                gone[at : at + 100] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_near_duplicates(odd, odd_rows):
    got = minhash.near_duplicates(odd)
    assert ordered(got.select("doc_id", "n_shingles", "component_id").collect()) == ordered(classes(odd_rows))
    assert {r.kept for r in got.where("doc_id = component_id").collect()} == {True}
    assert got.where("kept and (doc_id is null or doc_id <> component_id)").isEmpty()


def test_blocks_join_what_the_stars_miss(spark, monkeypatch):
    """A ring of texts of which neighbours alone are similar, in blocks of two."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "TRIES", 1)
    rows = [(k, " ".join(f"w{j}" for j in range(12 * k, 12 * k + 100))) for k in range(15)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got.select("doc_id", "n_shingles", "component_id").collect()) == ordered(classes(rows))


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).isEmpty()


def test_repeated_bytes(odd, odd_rows):
    short = odd.where("length(text) < 3000 or text is null")
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 3000]
    got = suffix.deduplicate(short)
    assert ordered(got.drop("kept").collect()) == ordered(repeated(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_repeated_bytes_of_long_texts(odd):
    got = {r.doc_id: r for r in suffix.deduplicate(odd).collect()}
    assert got[34].n_removed >= 4990 and got[31].n_removed == 0


def test_repeated_bytes_of_nothing(nothing):
    assert suffix.deduplicate(nothing).isEmpty()


def brute_hits(text, items):
    own, hit, found = alnum(text), set(), set()
    for item, body in items:
        w = alnum(body)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    return len(own), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def _items(odd_rows):
    return [(1, odd_rows[7][1]), (2, "TWO three"), (10, "gerade genug"), (3, None), (4, "..."), (None, "one two"), (5, "fünf Wörter sind gerade genug")]


def test_decontamination(spark, odd, odd_rows):
    items = _items(odd_rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = [(i, *brute_hits(t, items)) for i, t in odd_rows]
    got = decontam.decontaminate(odd, bench)
    assert ordered(got.collect()) == ordered(want)
    sliced = decontam.contamination(odd, bench, limit=40)
    assert ordered(sliced.select("doc_id", "n_words", "n_hit").collect()) == ordered([w[:3] for w in want])
    assert decontam.decontaminate(odd, bench.limit(0)).where("contaminated or n_hit > 0").isEmpty()
    assert decontam.decontaminate(odd.limit(0), bench).isEmpty()


def test_proximity(odd, odd_rows):
    index = decontam.build_index(odd.where("doc_id = 13"), None)
    near = decontam.proximity(index, "one", "four", 3).collect()
    assert [tuple(r) for r in near] == [(13, 0, 3)]
    assert decontam.proximity(index, "one", "four", 2).isEmpty()


def test_lattice_sums_all_segmentations():
    spans = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]
    weights = np.array([1.0, 2, 3, 4, 5, 6, 7])
    pieces = lm.Pieces(spans, weights)
    share = dict(zip(spans, weights / weights.sum(), strict=True))

    def total(rest):
        return 1.0 if not rest else sum(share[rest[:k]] * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in share)

    for word in (b"a", b"ab", b"abab", b"bbaabab", b"ba" * 30):
        got = lm.word_lattices([word], pieces)[0]
        if len(word) < 20:
            assert math.isclose(got, math.log(total(b" " + word)), rel_tol=1e-9)
        long = lm.long_lattice(np.frombuffer(b" " + word, np.uint8), pieces)
        assert math.isclose(got, long, rel_tol=1e-9)


def test_likelihood(odd, odd_rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words(t), None]
    count = Counter(w for i, t in odd_rows if not held(i) for w in tokens(t))
    total, types = sum(count.values()), len(count)
    want = [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in tokens(t)), 6)) for i, t in odd_rows]
    rows = lm.likelihood(odd).collect()
    assert ordered((*r[:5], round(r.base_score, 6)) for r in rows) == ordered(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_adapted_weights_fit_held_out_rows_better(spark):
    from ..conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain, adapted = (lm.likelihood(docs, rounds=k).where("held_out").agg({"score": "sum"}).first()[0] for k in (0, 1))
    assert adapted > plain


def test_likelihood_of_nothing(nothing):
    assert lm.likelihood(nothing).isEmpty()
