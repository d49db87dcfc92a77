"""Document quality from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Eight overlapping heuristics vote good, bad or abstain on each whole text.
Expectation-maximisation over the counts of vote patterns (at most 3**8 rows,
counted over all documents) estimates each labeller's accuracy and gives every
pattern a posterior; ``labeller_accuracy`` returns them as a table, and each
document names its ``lead``, the most accurate labeller that voted on it.
Posteriors of at most ``SAMPLE`` documents, those of the
smallest id hash (the documented bound of the fitting sample), then train a
logistic scorer on ``DIMS`` hashed features of word shapes, heads and tails,
which scores all documents.

Results for odd input: null or empty text has no words, gets the votes of an
empty text and the scorer's intercept; repeated rows are each scored; a null
doc_id is scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .scratch import store

LABELLERS = ("length", "case", "symbols", "variety", "word_length", "repeated_lines", "separators", "stutter")
ABSTAIN, BAD, GOOD = 0, 1, 2
DIMS = 1024
SAMPLE = 6000
ROUNDS = 60
#: Prior belief that a labeller doesn't call a good text bad, and its weight as a share of all documents.
TRUST, HOLD = 0.9995, 0.1
STEPS = 200
THRESHOLD = 0.5
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[65:91] = 1
_SHAPE[97:123] = 2
_SHAPE[48:58] = 3
_SHAPE[128:] = 4
_SHAPE[33:48] = _SHAPE[58:65] = _SHAPE[91:97] = _SHAPE[123:127] = 5


def votes(data: np.ndarray, bounds: np.ndarray, featured: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(votes, features): a row per document of labeller votes, and of hashed feature shares if asked for."""
    docs = len(bounds) - 1
    starts, ends, before = blocks.words(data, bounds, blocks.BLANK_WORDS)
    n = np.diff(before)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    shape = _SHAPE[data]
    upper, lower, other, symbol = (sums(shape == k) for k in (1, 2, 4, 5))
    letters = np.maximum(upper + lower + other, 1)
    hashes = blocks.span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(docs), n)
    variety = np.array([len(np.unique(hashes[a:b])) for a, b in zip(before[:-1], before[1:], strict=True)]) / np.maximum(n, 1)
    length = sums(blocks.BLANK_WORDS[data]) / np.maximum(n, 1)
    breaks = np.concatenate([np.flatnonzero(data == 10), bounds])
    breaks = np.unique(breaks)
    line_start, line_end = breaks[:-1], breaks[1:]
    line_doc = np.searchsorted(bounds, line_start, "right") - 1
    lines = blocks.span_hashes(data, np.minimum(line_start + (data[np.minimum(line_start, max(len(data) - 1, 0))] == 10 if len(data) else 0), line_end), line_end) if len(line_start) else np.zeros(0, np.uint64)
    first = np.unique(blocks.mix(lines + line_doc.astype(np.uint64) * np.uint64(blocks.MULTIPLIER)), return_index=True)[1]
    per_doc, distinct = np.bincount(line_doc, minlength=docs)[:docs], np.bincount(line_doc[first], minlength=docs)[:docs]
    repeated = 1 - distinct / np.maximum(per_doc, 1)
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    stuttered = np.bincount(owner, stutter, docs) / np.maximum(n, 1)
    single = np.bincount(owner, ends - starts == 1, docs) / np.maximum(n, 1)
    noisy = symbol / np.maximum(np.diff(bounds), 1)
    choose = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    table = np.stack([
        choose(n == 0, n >= 40), choose(upper / letters > 0.4, upper / letters < 0.15), choose(noisy > 0.06, noisy < 0.04),
        choose(variety < 0.25, variety > 0.4), choose((length < 2.5) | (length > 12), (length > 3.5) & (length < 9)), choose((repeated > 0.3) & (per_doc > 4), (repeated < 0.1) & (per_doc > 4)),
        choose(single > 0.15, single < 0.08), choose(stuttered > 0.1, stuttered < 0.03),
    ], axis=1)
    if not featured:
        return table, None
    features = np.zeros(docs * DIMS)
    if len(starts):
        signs = np.add.reduceat(np.uint64(1) << shape.astype(np.uint64) * np.uint64(8), starts) * np.uint64(2) + stutter
        for salt, h in enumerate((blocks.span_hashes(data, starts, np.minimum(starts + 3, ends)), blocks.span_hashes(data, np.maximum(starts, ends - 3), ends), blocks.mix(signs))):
            slot = (blocks.mix(h + np.uint64(salt)) >> np.uint64(54)).astype(np.int64)
            features += np.bincount(owner * DIMS + slot, minlength=docs * DIMS)
    features = np.sqrt(features.reshape(docs, DIMS) / np.maximum(3 * n, 1)[:, None]).astype(np.float32)
    return table, features


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, accuracy per labeller) by EM; a bad vote starts as bad, an abstention says nothing."""
    good = (patterns == GOOD).sum(axis=1)
    bad = (patterns == BAD).sum(axis=1)
    post = np.where(bad > 0, 0.1, 0.7 + 0.2 * (good > 0))
    total = counts.sum()
    for _ in range(ROUNDS):
        prior = ((counts * post).sum() + 1) / (total + 2)
        odds = np.full(len(patterns), np.log(prior) - np.log(1 - prior))
        for k in range(patterns.shape[1]):
            bad_vote, good_vote = patterns[:, k] == BAD, patterns[:, k] == GOOD
            share = []
            for weight, belief in ((counts * post, TRUST), (counts * (1 - post), 0.5)):
                strength = HOLD * total
                share.append(((weight @ bad_vote) + strength * (1 - belief)) / (weight @ (bad_vote | good_vote) + strength))
            odds += bad_vote * np.log(share[0] / share[1]) + good_vote * np.log((1 - share[0]) / (1 - share[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    given = [(counts * post) @ (patterns == GOOD) + (counts * (1 - post)) @ (patterns == BAD), counts @ (patterns != ABSTAIN)]
    return post, given[0] / np.maximum(given[1], 1e-9)


def train(features: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    weights, bias = np.zeros(features.shape[1], np.float32), np.float32(0)
    target = target.astype(np.float32)
    ahead, ahead_bias = weights, bias
    for step in range(1, STEPS + 1):
        gap = 1 / (1 + np.exp(-(features @ ahead + ahead_bias))) - target
        new, new_bias = ahead - np.float32(4) * (gap @ features / np.float32(len(target)) + np.float32(1e-5) * ahead), ahead_bias - np.float32(4) * gap.mean()
        pull = np.float32((step - 1) / (step + 2))
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = 3 ** np.arange(len(LABELLERS))
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                table, _ = votes(data, bounds, featured=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(table @ weight)], names=["doc_id", "pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                _, features = votes(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), pa.array([f.tobytes() for f in features], pa.binary())], names=["post", "features"])


@dataclass
class Model:
    """Vote patterns with their posteriors, labeller accuracies and coverages, and the linear scorer."""

    codes: np.ndarray
    patterns: np.ndarray
    post: np.ndarray
    accuracy: np.ndarray
    coverage: np.ndarray
    weights: np.ndarray
    bias: float

    def leads(self) -> list[str | None]:
        """For each pattern, the most accurate labeller that voted."""
        order = np.argsort(-self.accuracy, kind="stable")
        cast = self.patterns[:, order] != ABSTAIN
        return [LABELLERS[order[int(c.argmax())]] if c.any() else None for c in cast]


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = store(named.mapInArrow(_votes, "doc_id long, pattern long"), "votes")
    rows = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    n = np.array([r.n for r in rows], float)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    post, accuracy = estimate(patterns, n) if len(rows) else (np.zeros(0), np.zeros(len(LABELLERS)))
    coverage = n @ (patterns != ABSTAIN) / max(n.sum(), 1)
    known = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "pattern long, post double")

    picked = voted.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(SAMPLE).join(F.broadcast(known), "pattern").groupBy("doc_id").agg(F.min("post").alias("post"))
    sample = named.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "post").mapInArrow(_features, "post double, features binary")
    got = [(r.post, np.frombuffer(r.features, np.float32)) for r in store(sample, "sample").collect()]
    got.sort(key=lambda r: (r[0], r[1].tobytes()))
    weights, bias = train(np.stack([f for _, f in got]), np.array([p for p, _ in got])) if got else (np.zeros(DIMS), 0.0)
    return Model(codes, patterns, post, accuracy, coverage, weights, bias)


def labeller_accuracy(spark: SparkSession, model: Model) -> DataFrame:
    """(labeller, accuracy, coverage): the estimated share of right votes, and of documents it voted on."""
    rows = [(name, float(a), float(c)) for name, a, c in zip(LABELLERS, model.accuracy, model.coverage, strict=True)]
    return spark.createDataFrame(rows, "labeller string, accuracy double, coverage double")


def assess(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, weak (posterior of good from the votes), lead, score (of the trained scorer) and keep of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model or fit(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(zip(model.codes.tolist(), zip(model.post.tolist(), model.leads(), strict=True), strict=True))
        weight = 3 ** np.arange(len(LABELLERS))
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                    cast, features = votes(data, bounds)
                    weak, lead = zip(*(table.get(int(c), (0.5, None)) for c in cast @ weight), strict=True)
                    scores = 1 / (1 + np.exp(-(features @ model.weights + model.bias)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(weak, pa.float64()), pa.array(lead, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "weak", "lead", "score"])

    return named.mapInArrow(score, "doc_id long, weak double, lead string, score double").withColumn("keep", F.col("score") >= THRESHOLD)
