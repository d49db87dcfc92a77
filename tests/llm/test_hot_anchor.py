"""A passage shorter than a window in most documents: its anchor must not become one group of work."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc

from fathom.llm import suffix

from .test_text_operators import repeated


def _rows():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, left, right = line(85), [line(60) for _ in range(2500)], [line(60) for _ in range(2500)]
    return [(3 * k, rng.choice(left) + passage + rng.choice(right)) for k in range(9000)]


def test_hot_anchor_is_dealt_over_keys():
    rows = _rows()
    shards = [pa.table({"shard": pa.array([s] * len(own), pa.int64()), "doc_id": [i for i, _ in own], "sub": pa.array([0] * len(own), pa.int64()), "text": [t for _, t in own]}) for s, own in enumerate((rows[::2], rows[1::2]))]
    counted = pa.concat_tables([suffix._anchors(s) for s in shards])
    total = counted.group_by("key").aggregate([("n", "sum")]).filter(pc.field("n_sum") > 1)
    replies = counted.join(total, "key", join_type="inner")
    assert max(replies.column("n_sum").to_pylist()) > suffix.HOT
    replies = replies.append_column("kind", pc.if_else(pc.greater(replies.column("n_sum"), suffix.HOT), suffix.SPLIT, suffix.WHOLE))
    met = pa.concat_tables([suffix._shard_pieces(docs, replies.filter(pc.equal(replies.column("shard"), s)), 50) for s, docs in enumerate(shards)])
    sent = Counter()
    for r in met.to_pylist():
        for key, windows in zip(r["key"], r["windows"], strict=True):
            sent[key] += 56 + (windows + suffix.SIZE if r["transform"] else 0)
    assert max(sent.values()) <= 1.2 * suffix.COLLECTION


def test_hot_anchor_finds_the_same(spark):
    rows = _rows()
    got = suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("kept")
    assert sorted(map(tuple, got.collect())) == sorted(repeated(rows))
