"""Quality rules: statistics against plain counts, rules against their own definition and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import decision_list, queries

LARGER = "/root/testdata/sf0.01"
BLANKS = r"[^\x20\x09-\x0D]+"


def _plain(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(BLANKS, line):
            again, lines = again + (line in seen), lines + 1
            seen.add(line)
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    of = lambda kind: len(re.findall(kind, text))
    return (len(words), sum(map(len, words)), of(r"[#*$%&|<>]"), again, len(hit), lines, len(set(words)), stutter, sum(len(w) == 1 for w in words), of("[A-Z]"), of("[0-9]"), of(r"[!-/:-@\[-`{-~]"), max(map(len, words), default=0))


def _texts():
    rng = random.Random(3)
    out = ["a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a", "a a a a a", "\n\nx\nx\n x\nx", "x\r\nx\r\nx", "é é é\té\x0bé", "one\n\ntwo\n \none\n", "#*$%&|<> ##", "\n", "q" * 5000]
    return out + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 300))) for _ in range(200)] + [" ".join(rng.choice(["w", "v"]) for _ in range(40_000))]


def test_statistics(spark, odd_rows):
    rows = [(k, t) for k, t in enumerate([t for _, t in odd_rows] + _texts())]
    got = decision_list.statistics(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: tuple(r[c] for c in decision_list.COUNTS) for r in got} == {k: _plain(t) for k, t in rows}


def test_query_equals_its_definition(spark):
    """Every verdict recomputed from plain counts, the learner's rows and its rules, row by row."""
    got = {r.doc_id: r for r in queries.op13_quality_rules(spark, LARGER).collect()}
    docs = {r.doc_id: _plain(r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    labels = dict(spark.read.parquet(f"{LARGER}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.min("quality")).collect())
    place = dict(spark.createDataFrame([(i,) for i in labels], "doc_id long").select("doc_id", F.xxhash64("doc_id")).collect())
    rows = sorted(labels, key=lambda i: (labels[i], place[i]))
    table = {c: np.array([docs[i][k] for i in rows]) for k, c in enumerate(decision_list.COUNTS)}
    rules = decision_list.cover(decision_list.features(table), np.array([labels[i] == 0 for i in rows]), np.array([place[i] % 3 == 0 for i in rows]))
    assert rules and set(got) == set(docs)
    for i, counts in docs.items():
        named = dict(zip(decision_list.COUNTS, counts, strict=True))
        values = {f: named[a] / (1 if b is None else max(named[b], 1)) for f, (a, b) in decision_list.FEATURES.items()}
        first = next((t for t, rule in zip(decision_list.texts(rules), rules, strict=True) if all((values[c.feature] > c.cut) == c.above for c in rule)), None)
        failed = named["n_words"] < 10 or 100 * named["n_repeat_words"] > 20 * named["n_words"]
        assert (got[i].base_failed, got[i].rule, got[i].kept) == (failed, first, not failed and first is None)


def test_rules_hold_on_other_labels(spark):
    """Learned from sf0.01, judged on sf0.1: rows that the base rule leaves."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rules = decision_list.learn(decision_list.statistics(docs), labels)
    larger = LARGER.replace("0.01", "0.1")
    stats = decision_list.statistics(spark.read.parquet(f"{larger}/documents.parquet")).where(~decision_list.base_failed())
    judged = stats.withColumn("out", decision_list.verdict(rules).isNotNull()).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    poor, found, good, lost = judged.selectExpr("count_if(quality = 0)", "count_if(quality = 0 and out)", "count_if(quality = 1)", "count_if(quality = 1 and out)").first()
    assert found >= 0.85 * poor and lost <= 0.002 * good


def test_verdict_is_one_ordered_expression(spark):
    rules = [(decision_list.Condition("symbols", True, 0.5), decision_list.Condition("n_words", False, 3.5)), (decision_list.Condition("n_words", False, 9.0),)]
    rows = decision_list.statistics(spark.createDataFrame([(1, "## ## a"), (2, "a b c d"), (3, "a " * 12), (4, None)], "doc_id long, text string"))
    judged = rows.withColumn("v", decision_list.verdict(rules))
    assert {r.doc_id: r.v for r in judged.collect()} == {1: 1, 2: 2, 3: None, 4: 2}


def test_covering_stops_at_noise():
    rng = np.random.default_rng(1)
    values = {"word_length": rng.random(2000), "symbols": np.where(np.arange(2000) < 300, 0.9, 0.1)}
    poor = np.arange(2000) < 300
    rules = decision_list.cover(values, poor, np.arange(2000) % 3 == 0)
    assert [decision_list.texts(rules)[0].split(" ")[:2]] == [["symbols", ">"]] and len(rules) == 1
    assert decision_list.cover(values, rng.random(2000) < 0.2, np.arange(2000) % 3 == 0) == []


def test_odd_rows(odd, odd_rows, nothing, spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 0), (7, None)], "doc_id long, quality int")
    rows = decision_list.assess(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert decision_list.assess(nothing, labels).isEmpty()
    bare = decision_list.assess(odd, labels.where("quality = 0")).collect()
    assert all(r.kept != r.base_failed and r.rule is None for r in bare)
