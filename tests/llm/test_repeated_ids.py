"""Near duplicates where one id names several texts: every link counts, whichever text of an id it comes from."""

import random

from fathom.llm import minhash


def _sets(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _plain(rows):
    """(id, size, component) of every row: links between texts, and between all rows of an id; a row without words is linked with nothing."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(i, _sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(held):
        for j, b in held[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(s), root(i) if s else i) for i, s in held)


def _near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def _got(spark, rows):
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)


def test_an_id_with_two_texts_links_both(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b = say(80), say(90)
    rows = [(1, a), (1, b), (2, _near(rng, a)), (3, _near(rng, b))]
    assert [r[2] for r in _got(spark, rows)] == [1, 1, 1, 1] and _got(spark, rows) == _plain(rows)


def test_random_rows_with_repeated_ids(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    bases = [say(70) for _ in range(12)]
    rows = []
    for _ in range(60):
        text = rng.choice(bases)
        for _ in range(rng.randrange(3)):
            text = _near(rng, text)
        rows.append((rng.randrange(40), rng.choice([text, text, say(6), "", "one two"])))
    rows += [rows[0], rows[1], (rows[2][0], None)]
    assert _got(spark, rows) == _plain(rows)
