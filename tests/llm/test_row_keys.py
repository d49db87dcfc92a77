"""Pipeline stages on rows that doc_id doesn't tell apart."""

import random

import corpus_pipeline
import pytest

from fathom.llm import suffix

rng = random.Random(11)
say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
SHARED, BENCH = say(25), say(10)
ALONE = [say(60) for _ in range(4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, ALONE[0]), (None, ALONE[1]), (None, f"{say(25)} {SHARED}"), (None, f"{SHARED} {say(27)}"), (None, f"{say(8)} {BENCH}"), (None, ""), (None, "")]
    rows += [(3, ALONE[2]), (3, ALONE[3]), (3, f"{say(9)} {BENCH}"), (4, say(50)), (4, None)]
    rows += [(None, ALONE[0]), (3, ALONE[3]), (9, ALONE[1]), (9, ALONE[2])]
    full = [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _bag(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_one_of_equal_texts_stays(spark, docs):
    got, rows = _bag(corpus_pipeline.drop_near_copies(spark, docs, "")), _bag(docs)
    assert sorted(t for _, t in got if t) == sorted({t for _, t in rows if t})
    assert [r for r in got if not r[1]] == [r for r in rows if not r[1]]
    assert (9, ALONE[1]) in got and (None, ALONE[0]) in got


def test_every_row_keeps_its_text(spark, docs):
    """Only the passage that two rows without an id share is cut, in one of them; columns stay with their text."""
    once = docs.where("source not in ('s12', 's13', 's14', 's15', 's4', 's9')")
    before = {r.source: r for r in once.collect()}
    after = {r.source: r for r in corpus_pipeline.cut_repeats(spark, once, "").collect()}
    assert set(after) == set(before)
    changed = {s for s in before if before[s].text != after[s].text}
    assert len(changed) == 1 and changed < {"s2", "s3"} and all(before[s].doc_id == after[s].doc_id for s in before)
    assert len(SHARED) - 2 <= len(before[min(changed)].text) - len(after[min(changed)].text) <= len(SHARED) + 2
    assert sorted(r.n_removed > 0 for r in suffix.deduplicate(once).collect()).count(True) == 1


def test_contaminated_rows_go(spark, docs, tmp_path):
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = _bag(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)))
    assert got == [r for r in _bag(docs) if BENCH not in (r[1] or "")]
