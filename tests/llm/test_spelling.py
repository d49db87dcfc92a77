"""Spelling variants against plain counts and edit distances over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from fathom.llm import spelling


def _counted(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def _plain(words):
    near = {w: [(-n, v) for v, n in words.items() if _one_apart(w, v)] for w in words}
    form = {w: min(x) if x else None for w, x in near.items()}
    form = {w: f[1] if f and -f[0] >= 5 * words[w] else None for w, f in form.items()}
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


@pytest.fixture(scope="module")
def typed():
    rng = random.Random(8)
    base = ["".join(rng.choice("aàbcé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    said = []
    for w in base:
        for depth in (150, 25, 5):
            said += [w] * depth
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abxÿ") + w[k:], w[:k] + "x" + w[k + 1 :]])
    rng.shuffle(said)
    said += ["aaaaaa"] * 9 + ["aaaaaaa"] * 7 + ["Aaaaaaaa"] * 6 + ["×÷×÷×÷"] * 5 + ["Ā" * 8] * 9 + ["y" * 300] * 6
    rows = [(k, " ".join(said[k::23])) for k in range(23)]
    return rows + [(None, "banane1banana banana_BANANA-banana banana"), (3, None), (4, ""), (99, " ".join(["lettre"] * 400))]


def test_variants(spark, typed):
    got = spelling.variants(spark.createDataFrame(typed, "doc_id long, text string").repartition(3)).collect()
    want = _plain(_counted(typed))
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(r.form and r.root != r.form for r in got) and any(r.n_near > 1 for r in got)


@pytest.mark.parametrize("size", [1, 7])
def test_hot_halves_are_split(spark, typed, size):
    """Buckets far smaller than the words that share a half."""
    words = _counted(typed) | {f"abcabc{x}{y}": 5 for x in "abcdefg" for y in "abcdefg"}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.forms(given, size).collect()
    assert sorted((r.word, r.form, r.n, r.n_near) for r in got) == [(w, f, n, m) for w, f, _, n, m, _ in _plain(words)]
    pairs = spelling.near_pairs(given, size).collect()
    assert sorted((r.word, r.near) for r in pairs) == sorted((a, b) for a in words for b in words if _one_apart(a, b))


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"".join(x) for x in ("abcd", "abd", "bcd", "bd", "acd", "abcde", "a")})
    made = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = made.walk(w)
        assert made.final[state] and number == k
    assert made.walk("abx") is None and len({id(a) for a in made.arcs}) >= 5
    assert made.within_one("", "abc") == {k for k, w in enumerate(words) if _one_apart("abc", w)}
    assert spelling.Automaton([]).within_one("a", "b") == set()


def test_a_long_text_is_counted_in_pieces(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(5, 8))) for _ in range(120_000)) + " " + "q" * 700_000 + " endend" * 6
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()}
    assert got == _counted([(5, text)])


def test_nothing(nothing, spark):
    assert spelling.variants(nothing).isEmpty()
    assert spelling.variants(spark.createDataFrame([(1, "few short words")], "doc_id long, text string")).isEmpty()
