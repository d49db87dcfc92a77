"""Every stage of the corpus pipeline on its own input, against brute force."""

import pytest

import corpus_pipeline
from fathom.llm import toxicity

from ..conftest import DATA
from .test_text_operators import brute_hits, classes, repeated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """(name, input rows, output rows) of each stage, chained."""
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.store(stage(spark, docs, DATA), "test")
        out.append((docs, after))
        docs = after
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(after.columns == COLUMNS for _, after in steps[:-1])
    assert steps[-1][1].columns[: len(COLUMNS)] == COLUMNS


def test_toxic_documents_go(spark, steps):
    docs, after = steps[0]
    index = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    low = {r.doc_id for r in toxicity.score(docs, index).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert set(_texts(after)) == low


def test_one_of_each_class_stays(steps):
    before, after = steps[1]
    rows = sorted(_texts(before).items())
    found = {i: label for i, _, label in classes(rows)}
    assert set(_texts(after)) == {i for i, label in found.items() if i == label} and len(found) > after.count()


def test_repeats_are_cut(steps):
    before, after = steps[2]
    rows = sorted(_texts(before).items())
    left, kept = _texts(after), {i: (n, gone) for i, n, gone, _, _ in repeated(rows)}
    assert set(left) == {i for i, (n, gone) in kept.items() if gone == 0 or gone < n}
    for i, text in rows:
        n, gone = kept[i]
        if gone == 0:
            assert left[i] == text
        elif i in left:
            assert n - gone - 6 * (1 + gone // 100) <= len(left[i].encode()) <= n - gone
    assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())


def test_contaminated_documents_go(spark, steps):
    before, after = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i, t in _texts(before).items() if not brute_hits(t, items)[-1]}
    assert set(_texts(after)) == clean


def test_mixing_keeps_all(steps):
    before, after = steps[4]
    assert _texts(before) == _texts(after)
    rows = after.collect()
    assert len({(r.slot, r.place) for r in rows}) == len(rows) and all(r.release <= r.slot < r.deadline for r in rows)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, odd, odd_rows, nothing, k):
    """Nulls, blanks, repeated rows and clashing columns pass; null and empty texts stay as they are; nothing gives nothing."""
    stage = corpus_pipeline.STAGES[k][1]
    after = corpus_pipeline.store(stage(spark, odd, DATA), "odd")
    assert after.columns[: len(odd.columns)] == odd.columns or k == 4
    assert set(odd.columns) <= set(after.columns)
    blank = sorted(((i, t) for i, t in odd_rows if not (t or "")), key=repr)
    assert sorted(((r.doc_id, r.text) for r in after.where("coalesce(text, '') = ''").collect()), key=repr) == blank
    assert after.where("label <> 'l' or shard <> 2 or n <> 3 or key <> 'k'").isEmpty()
    assert stage(spark, nothing, DATA).isEmpty()


def test_entry_without_the_subpackage(tmp_path):
    """Without these folders the other queries still register."""
    import subprocess
    import sys

    code = "import sys; sys.modules['fathom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=".", check=False).returncode == 0
