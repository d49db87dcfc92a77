"""Ranked search against scores added up in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from fathom.llm import ranked


def _plain(docs, items):
    """(item, rank, doc, score) of rows (id, text), term by term."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, c, n in held:
            m = 75 + 25 * n * total // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, k in terms.items() if w in c)
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:20], 1)]
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture()
def asked(spark, odd_rows):
    rows = [(1, "One TWO three one"), (2, None), (2, "fünf Wörter"), (3, ""), (None, "three four"), (5, "zzz none of these"), (6, "ab x " * 40), (7, "three"), (8, odd_rows[14][1][:40])]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows(odd, odd_rows, asked):
    rows, items = asked
    got = ranked.search(odd, items).collect()
    assert _sorted(got) == _sorted(_plain(odd_rows, rows)) and any(r.doc_id is None for r in got) and any(r.item_id is None for r in got)


def test_small_blocks_give_the_same(odd, odd_rows, asked, monkeypatch):
    """Many blocks of documents and of queries, few triples at once."""
    for name, size in (("DOC_ENTRIES", 3), ("QUERY_ENTRIES", 2), ("TRIPLES", 4)):
        monkeypatch.setattr(ranked, name, size)
    rows, items = asked
    assert _sorted(ranked.search(odd, items).collect()) == _sorted(_plain(odd_rows, rows))


def test_ties_go_to_the_smaller_ids(spark):
    docs = [(k, "alpha beta") for k in range(50, 0, -1)] + [(100 + k, "gamma delta") for k in range(60)]
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("q", "alpha")], "item_id string, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [("q", k, k) for k in range(1, 21)]


def test_nothing(odd, nothing, spark, asked):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked.search(nothing, asked[1]).isEmpty() and ranked.search(odd, none).isEmpty()


def test_radix_order():
    rng = np.random.default_rng(2)
    for top in (1, 1 << 15, 1 << 33, 1 << 62):
        keys = rng.integers(0, top, 3000).astype(np.uint64)
        assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked.radix_order(np.zeros(0, np.uint64))) == 0
