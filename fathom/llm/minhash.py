"""Near-duplicate classes by MinHash with tensored banding.

Two small collections of ``HALVES`` half-keys (``WIDE`` minhashes each) are
computed per document; table (i, j) is keyed by the pair (a_i, b_j). So
HALVES**2 tables cost 2 * HALVES * WIDE minhashes rather than
2 * HALVES**2 * WIDE. A pair of similarity s meets in no table with probability
at most 2 * (1 - s**WIDE)**HALVES: 2.2e-4 at 0.75, 6e-6 at 0.8, 3e-8 at 0.85.

Every link is confirmed on the full shingle sets. Equal sets form one class
before any banding, so exact copies cost one aggregation. Each table
bucket has one centre (a star, linear in the bucket), the member with the fewest
shingles of its own; a document is tried against the ``TRIES`` centres it meets
most often, in turn. Components that mixed buckets still hold are then compared
exhaustively in blocks of about ``BLOCK`` x ``BLOCK`` sets, each block pair a
group of its own, which emits links that join components, never pairs as such. Documents that cannot reach the
similarity are left out first: shingles that no other candidate has lie outside
every intersection, so with u of those, n shingles and m = min(n_x - u_x,
n_y - u_y), the similarity is at most m / (m + u_x + u_y). The bound is exact,
so a bucket loses no link between its members.

Results for odd input: null, empty or blank text has an empty set, is linked
with nothing and is its own component; repeated rows each get a result row; a
null doc_id keeps its row, with component_id the smallest known id of its class
or null; texts of one id are linked by it (an empty set isn't), each row with the
size of its own set;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .scratch import store

SHINGLE = 5
WIDE = 4
HALVES = 24
BLOCK = 512
#: Centres that a document is tried against in turn before buckets are compared in full.
TRIES = 3
_SEED = np.random.Generator(np.random.PCG64(7))
_ODD = (_SEED.integers(0, 2**31, 2 * HALVES * WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _SEED.integers(0, 2**32, 2 * HALVES * WIDE, dtype=np.uint32)[:, None]
_PLACE = blocks.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SLOT = blocks.mix(np.arange(100, 100 + 2 * HALVES, dtype=np.uint64))
_COEF = blocks.mix(np.arange(900, 900 + WIDE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text in turn."""
    for _, _, data, bounds in blocks.chunks(column):
        tokens, before = blocks.lowered_words(data, bounds, blocks.BLANK_WORDS)
        spread = [tokens * _PLACE[k] for k in range(size)]
        runs = np.zeros(0, np.uint64)
        if len(tokens) >= size:
            runs = spread[0][: len(tokens) - size + 1].copy()
            for k in range(1, size):
                runs += spread[k][k : len(tokens) - size + 1 + k]
            runs = blocks.mix(runs)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(b - a):
                    whole = whole + spread[k][a + k]
                yield blocks.mix(np.array([whole], np.uint64))
            else:
                yield runs[:0]


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """The 2 * HALVES half-keys of a set; the first HALVES belong to side a."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full((len(_ODD), 1), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        part = low[None, k : k + 4096]
        least = np.minimum(least, ((part ^ _XOR) * _ODD).min(axis=1, keepdims=True))
    rows = least.reshape(2 * HALVES, WIDE).astype(np.uint64)
    return blocks.mix((rows * _COEF).sum(axis=1, dtype=np.uint64) + _SLOT)


_PROFILE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()), T.StructField("halves", T.BinaryType()),
])


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            counts, digests, halves = [], [], []
            for s in shingle_sets(batch.column(1)):
                counts.append(len(s))
                digests.append(_digest(s))
                halves.append(half_keys(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(halves, pa.binary())], names=_PROFILE.names)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        raw, _ = blocks.text_arrays(batch.column(1))
        keys = raw.view(np.int64) if len(raw) else np.zeros(0, np.int64)
        side = np.tile(np.arange(2 * HALVES) >= HALVES, len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, 2 * HALVES)), pa.array(keys), pa.array(side)], names=["doc", "key", "second"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            column = batch.column(1)
            for lo in range(0, len(column), 512):
                part = column.slice(lo, 512)
                sets = [blocks.signed(s) for s in shingle_sets(part)]
                digests = pa.array([_digest(s) for s in sets], pa.binary())
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), digests, pa.ListArray.from_arrays(pa.array(bounds), values)], names=["doc", "digest", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable over undirected edges (x, y).

    Labels move along edges and then jump through their own label, so the
    rounds grow with the logarithm of a component's depth.
    """
    both = edges.select(F.col("x").alias("v"), F.col("y").alias("w")).union(edges.select("y", "x")).distinct()
    both = store(both, "links")
    labels = both.groupBy("v").agg(F.least("v", F.min("w")).alias("label"))
    labels = store(labels, "labels")
    total = None
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        moved = labels.join(near, "v").select("v", F.least("label", "near").alias("label"))
        hop = labels.select(F.col("v").alias("label"), F.col("label").alias("hop"))
        labels = store(moved.join(hop, "label", "left").select("v", F.least("label", "hop").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (x, y) whose full sets are similar enough."""
    a = sets.select(F.col("doc").alias("x"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc").alias("y"), F.col("shingles").alias("b"))
    joined = pairs.join(a, "x").join(b, "y").withColumn("n", F.size(F.array_intersect("a", "b")).cast("long"))
    return joined.where(F.col("n") * 100 >= percent * (F.size("a") + F.size("b") - F.col("n"))).select("x", "y")


def _block_links(clusters: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that join different labels among the documents of each cluster of labels, found block pair by block pair.

    placed has doc, label, own and open; clusters (v, label) has the cluster of a
    label. The label with most documents of a cluster has blocks of its own,
    which are compared with the other labels' blocks but not with each other.
    """
    members = placed.join(clusters.select(F.col("v").alias("label"), F.col("label").alias("cluster")), "label")
    by = members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.min("own").alias("own"))
    sized = by.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.min(F.struct("own", "label")).alias("least"))
    second = by.join(sized.select("cluster", "least"), "cluster").where("label <> least.label").groupBy("cluster").agg(F.min("own").alias("second"))
    sized = sized.join(second, "cluster").select("cluster", "main", "least", "second", F.ceil(F.col("most") / BLOCK).cast("long").alias("a"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("long").alias("b"))
    dealt = members.join(sized, "cluster").withColumn("other", F.expr("if(label = least.label, second, least.own)"))
    dealt = dealt.where(f"{100 - percent} * open >= {percent} * (own + other)").withColumn("own", F.expr("if(label = main, pmod(xxhash64(doc), a), a + pmod(xxhash64(doc), b))"))
    dealt = dealt.select("doc", "label", "cluster", "own", F.expr("if(label = main, sequence(a, a + b - 1), sequence(0L, a + b - 1))").alias("others"))
    dealt = dealt.join(sets, "doc").withColumn("other", F.explode("others"))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc", "label", "shingles")

    def join(table: pa.Table) -> pa.Table:
        doc, label = (np.asarray(table.column(c).combine_chunks()) for c in ("doc", "label"))
        lists = table.column("shingles").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        values = np.asarray(lists.flatten())
        terms, back = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(doc)), sizes)
        shared = np.bincount(back, minlength=len(terms)) > 1
        place = (np.cumsum(shared) - 1)[back]
        row, place = row[shared[back]], place[shared[back]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        both = np.zeros((len(doc), len(doc)), np.float32)
        for lo in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(place, [lo, lo + 2048])
            part = np.zeros((len(doc), 2048), np.float32)
            part[row[a:b], place[a:b] - lo] = 1
            both += part @ part.T
        joined = (100 + percent) * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :])
        joined &= label[:, None] != label[None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(np.triu(joined, 1)), strict=True):
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
        return pa.table({"x": pa.array([p[0] for p in out], pa.int64()), "y": pa.array([p[1] for p in out], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(join, "x long, y long")


def _numbered(classes: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes (digest, low: its least id) with doc, a number of each; and the links between classes that share an id, None if there are none.

    The number is low where no other class has it, else beyond all ids. A class
    numbered so shares its low with one that is numbered by it, so the least
    number of a component is still its least id.
    """
    held = profile.where("digest is not null and doc_id is not null")
    several = store(held.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    if several.isEmpty():
        return classes.withColumn("doc", F.col("low")), None
    beyond = held.agg(F.max("doc_id")).first()[0] + 1
    firsts = classes.groupBy("low").agg(F.min("digest").alias("digest")).withColumn("first", F.lit(True))
    numbers = classes.join(firsts, ["low", "digest"], "left").withColumn("new", F.monotonically_increasing_id() + F.lit(beyond))
    classes = store(numbers.select("digest", "low", F.when(F.col("first"), F.col("low")).otherwise(F.col("new")).alias("doc")), "numbered")
    shared = store(held.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "doc"), "digest").select("doc_id", "doc"), "shared")
    heads = shared.groupBy("doc_id").agg(F.min("doc").alias("x"))
    return classes, shared.join(heads, "doc_id").where("doc <> x").select("x", F.col("doc").alias("y")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = store(named.mapInArrow(_profile, _PROFILE), "profiles")
    classes = profile.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("low"))
    classes, alike = _numbered(store(classes, "classes"), profile)

    lone = profile.where("digest is not null").join(classes.withColumnRenamed("low", "doc_id"), ["doc_id", "digest"]).select("doc", "halves").dropDuplicates(["doc"])
    keys = lone.mapInArrow(_halves, "doc long, key long, second boolean")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = keys.join(shared, "key", "left_semi")
    sides = keys.groupBy("doc").agg(F.collect_list(F.when(~F.col("second"), F.col("key"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("key"))).alias("b"))
    tables = sides.select("doc", F.explode("a").alias("a"), "b").select("doc", "a", F.explode("b").alias("b")).select("doc", F.xxhash64("a", "b").alias("bucket"))
    full = tables.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = store(tables.join(full, "bucket", "left_semi"), "buckets")

    members = buckets.select("doc").distinct()
    if alike is None:
        texts = named.where("doc_id is not null").join(members, named.doc_id == members.doc, "left_semi").dropDuplicates(["doc_id"])
    else:
        asked = classes.join(members, "doc", "left_semi")
        texts = named.join(asked.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").distinct()
    found = texts.mapInArrow(_sets, "doc long, digest binary, shingles array<long>")
    if alike is not None:
        found = found.select("digest", "shingles").join(asked.select("digest", "doc"), "digest").dropDuplicates(["doc"])
    sets = store(found.select("doc", "shingles"), "sets")
    lone = sets.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.max("doc").alias("doc")).where("n = 1").groupBy("doc").agg(F.count("*").alias("own"))
    sized = store(sets.select("doc", F.size("shingles").alias("size")).join(lone, "doc", "left").select("doc", F.coalesce("own", F.lit(0)).alias("own"), (F.col("size") - F.coalesce("own", F.lit(0))).alias("open")), "sizes")
    placed = buckets.join(sized, "doc")
    can_link = f"{100 - percent} * least({{0}}open, {{1}}open) >= {percent} * ({{0}}own + {{1}}own)"

    centres = placed.groupBy("bucket").agg(F.min(F.struct("own", "doc", "open")).alias("c")).select("bucket", F.col("c.doc").alias("centre"), F.col("c.own").alias("cown"), F.col("c.open").alias("copen"))
    tried = placed.join(centres, "bucket").where("doc <> centre").where(can_link.format("", "c")).groupBy("doc", "centre").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("centre")).alias("back"))), False), 1, TRIES)
    waiting = store(tried.groupBy("doc").agg(best.alias("best")), "tried")
    found = []
    for k in range(TRIES):
        own = waiting.where(F.size("best") > k).select("doc", (-F.get("best", F.lit(k)).getField("back")).alias("centre"))
        own = own.select("doc", F.least("doc", "centre").alias("x"), F.greatest("doc", "centre").alias("y"))
        found.append(store(_confirmed(own.select("x", "y").distinct(), sets, percent), "confirmed"))
        waiting = waiting.join(own.join(found[-1], ["x", "y"], "left_semi").select("doc"), "doc", "left_anti")
    links = reduce(DataFrame.union, found if alike is None else [*found, alike])

    first = components(links)
    named_by = first.withColumnRenamed("v", "doc")
    placed = placed.join(named_by, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    held = placed.groupBy("bucket", "label").agg(F.min("own").alias("own"), F.max(F.expr(f"{100 - percent} * open - {percent} * own")).alias("reach"))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("own").alias("least")).where("lo < hi").select("bucket", "least")
    held = store(held.join(mixed, "bucket").where(f"reach >= {percent} * least").select("bucket", "label"), "held")
    heads = held.groupBy("bucket").agg(F.min("label").alias("x"))
    spokes = store(held.join(heads, "bucket").where("label <> x").select("x", F.col("label").alias("y")).distinct(), "spokes")
    labelled = sized.join(named_by, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    late = store(_block_links(components(spokes), labelled, sets, percent), "late")
    if late.isEmpty():
        labels = first
    else:
        labels = components(links.union(late))

    found = classes.join(labels.withColumnRenamed("v", "doc"), "doc", "left").select("digest", F.coalesce("label", "doc").alias("component"))
    out = profile.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
