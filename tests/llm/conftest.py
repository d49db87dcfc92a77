"""Small documents with every odd case: nulls, blanks, ties, repeated rows, a long text, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, bucket long, shard long, n long, key string"


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, base = say(60), say(120).split(" ")
    texts = [None, "", " \t\n", "one", "One two THREE four", "one two three four", "fünf Wörter sind gerade genug", f"{say(20)} {passage}", f"{passage} {say(30)}", f"{say(5)} {passage[10:]} {passage}", say(30000)]
    texts += [f"{texts[10][:5000]} {say(10)}", "ab" * 400, "x" * 250, passage, passage]
    for k in range(12):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 3 + [say(40) for _ in range(10)]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, passage), (None, None), (200, None), (-5, "one two three four")]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "l", 1, 2, 3, "k") for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id = 123456789")
