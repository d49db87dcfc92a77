"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

``fit`` takes at most ``PER_CLASS`` labelled training rows of each label (those
of smallest id hash; the documented bound of the fitting sample), picks the
terms that go with label 1 on that sample (lower-cased words, and first
``STEM`` bytes of longer words) and no others, and builds postings over blocks of examples
with the greatest weight of every term in every block. ``score`` visits blocks
in order of their bound and stops when no later block can enter the ``NEAREST``
best, so the neighbours are exact. Votes are weighted by cosine and by how much
of its class each example stands for, with the base rate as a prior vote; that
makes the score an estimate of the share of label 1.

The fitted index is bounded by 2 * PER_CLASS examples and MAX_TERMS terms and
travels with the tasks; all documents are scored, whole, in one map without a
shuffle. A document that shares no term with any example gets the base rate.

Results for odd input: null or empty text scores the base rate; labels of null
id, null label or without a document are ignored; a repeated document or label
row counts once, and of several texts of one id that of least hash; without labelled rows the base rate is 0; a null doc_id is
scored and never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .minhash import shingle_sets
from .scratch import store

PER_CLASS = 2000
STEM = 5
MIN_LIFT = 4.0
#: How far beyond chance, in likelihood-ratio units above 2 ln(terms), a term must go with label 1.
MARGIN = 2.0
MAX_TERMS = 20_000
NEAREST = 15
BLOCK = 64
PRIOR_WEIGHT = 0.3
THRESHOLD = 0.3


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of the stems of longer words, each with counts before every document."""
    data = blocks.LOWER[data]
    starts, ends, before = blocks.words(data, bounds, blocks.ALNUM_WORDS)
    whole = blocks.span_hashes(data, starts, ends)
    long = ends - starts > STEM
    stems = blocks.span_hashes(data, starts[long], starts[long] + STEM) ^ np.uint64(0x5555555555555555)
    return whole, before, stems, np.concatenate([[0], np.cumsum(long)])[before]


@dataclass
class Index:
    """Block-max postings of the labelled examples."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    bounds: np.ndarray  # of each term's postings
    example: np.ndarray  # sorted within a term
    weight: np.ndarray  # of unit vectors
    most: np.ndarray  # (term, block) greatest weight
    label: np.ndarray
    mass: np.ndarray  # rows that an example stands for
    ids: np.ndarray
    rate: float

    def vector(self, whole: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term places, unit weights) of a document."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        both = np.concatenate([whole, stems])
        at = np.minimum(np.searchsorted(self.terms, both), len(self.terms) - 1)
        found, n = np.unique(at[self.terms[at] == both], return_counts=True)
        w = (1 + np.log(n)) * self.idf[found]
        return found, w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, found: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k most similar, ties to the smaller example; exact."""
        bound = w @ self.most[found]
        order = np.argsort(-bound, kind="stable")
        best, cos = np.zeros(0, np.int64), np.zeros(0)
        for b in order:
            if bound[b] <= 0 or len(best) == k and bound[b] < cos[-1] - 1e-9:
                break
            lo, hi = b * BLOCK, (b + 1) * BLOCK
            sums = np.zeros(BLOCK)
            for t, q in zip(found, w, strict=True):
                s, e = self.bounds[t], self.bounds[t + 1]
                u, v = s + np.searchsorted(self.example[s:e], [lo, hi])
                sums[self.example[u:v] - lo] += q * self.weight[u:v]
            own = np.flatnonzero(sums > 0)
            best, cos = np.concatenate([best, own + lo]), np.concatenate([cos, sums[own]])
            keep = np.lexsort((best, -np.round(cos, 12)))[:k]
            best, cos = best[keep], cos[keep]
        return best, cos

    def score(self, found: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, evidence examples, cosines)."""
        if not len(found):
            return self.rate, found, w
        best, cos = self.nearest(found, w)
        votes = cos * self.mass[best]
        scale = float(self.mass.min()) if len(self.mass) else 1.0
        prior = PRIOR_WEIGHT * scale
        return float((votes @ self.label[best] + prior * self.rate) / (votes.sum() + prior)), best, cos


_ODD = blocks.mix(np.arange(50, 58, dtype=np.uint64)) | np.uint64(1)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """Eight minhashes of a set, none of an empty one."""
    return (shingles[None, :] * _ODD[:, None]).min(axis=1) if len(shingles) else shingles


def families(minhashes: list[np.ndarray]) -> np.ndarray:
    """The size of each example's family of near copies, which share pairs of minhashes."""
    parent = list(range(len(minhashes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    seen: dict[tuple, int] = {}
    for k, least in enumerate(minhashes):
        for j in range(0, len(least), 2):
            first = seen.setdefault((j, int(least[j]), int(least[j + 1])), k)
            parent[root(k)] = root(first)
    roots = np.array([root(k) for k in range(len(minhashes))], np.int64)
    return np.bincount(roots, minlength=1)[roots]


def beyond_chance(hot: np.ndarray, cold: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood ratio of a term's share in two classes against one common share."""

    def part(x: np.ndarray, n: float, share: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(x * np.log(share), nan=0, posinf=0, neginf=0) + np.nan_to_num((n - x) * np.log1p(-share), nan=0, posinf=0, neginf=0)

    common = (hot + cold) / (n1 + n0)
    return 2 * (part(hot, n1, hot / n1) + part(cold, n0, cold / n0) - part(hot, n1, common) - part(cold, n0, common))


def build(whole: list[np.ndarray], stems: list[np.ndarray], family: np.ndarray, label: np.ndarray, mass: np.ndarray, ids: np.ndarray, rate: float) -> Index:
    """Choose terms, weigh and index the examples."""
    n = len(label)
    sets = [np.unique(np.concatenate([a, b])) for a, b in zip(whole, stems, strict=True)]
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    terms, back = np.unique(flat, return_inverse=True)
    vote = 1.0 / family
    hot, cold = (np.bincount(back, (vote * (label == v))[owner], len(terms)) if n else np.zeros(0) for v in (1, 0))
    n1, n0 = (max(vote[label == v].sum(), 1.0) for v in (1, 0))
    lift = ((hot + 0.5) / (n1 + 1)) / ((cold + 0.5) / (n0 + 1))
    keep = (lift >= MIN_LIFT) & (beyond_chance(hot, cold, n1, n0) >= 2 * np.log(max(len(terms), 1)) + MARGIN)
    if keep.sum() > MAX_TERMS:
        keep &= lift >= np.sort(lift[keep])[-MAX_TERMS]
    terms, idf = terms[keep], np.log((1 + n1 + n0) / (1 + (hot + cold)[keep])) + 1
    out = Index(terms, idf, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(terms), -(-n // BLOCK))), label, mass, ids, rate)
    rows = [out.vector(a, b) for a, b in zip(whole, stems, strict=True)]
    term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)])
    weight = np.concatenate([np.zeros(0), *(w for _, w in rows)])
    example = np.repeat(np.arange(n), [len(t) for t, _ in rows])
    order = np.lexsort((example, term))
    out.example, out.weight = example[order], weight[order]
    out.bounds = np.searchsorted(term[order], np.arange(len(terms) + 1))
    np.maximum.at(out.most, (term, example // BLOCK), weight)
    return out


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index:
    """An index of a bounded sample of the labelled rows that are not held out."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = store(marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [marked.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                    whole, before, stems, stems_before = term_hashes(data, bounds)
                    cols: list[list[bytes]] = [[], [], [], [], []]
                    for k, shingles in enumerate(shingle_sets(batch.column(1).slice(lo, hi - lo))):
                        a = np.unique(whole[before[k] : before[k + 1]], return_counts=True)
                        b = np.unique(stems[stems_before[k] : stems_before[k + 1]], return_counts=True)
                        for col, x in zip(cols, (*a, *b, least_hashes(shingles)), strict=True):
                            col.append(x.tobytes())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "toxic", "whole", "n_whole", "stems", "n_stems", "least"])

    kept = sample.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(terms, "doc_id long, toxic int, whole binary, n_whole binary, stems binary, n_stems binary, least binary")
    number = lambda b, kind=np.uint64: np.frombuffer(b, kind)
    rows = [(r.doc_id, r.toxic, (number(r.whole), number(r.n_whole, np.int64)), (number(r.stems), number(r.n_stems, np.int64)), number(r.least)) for r in kept.toLocalIterator()]
    rows.sort(key=lambda r: r[0])
    label = np.array([r[1] for r in rows], np.int64)
    total = max(sum(counts.values()), 1)
    size = {v: max((label == v).sum(), 1) for v in (0, 1)}
    mass = np.array([counts.get(int(v), 0) / size[int(v)] for v in label])
    again = lambda pair: np.repeat(*pair)
    return build([again(r[2]) for r in rows], [again(r[3]) for r in rows], families([r[4] for r in rows]), label, mass, np.array([r[0] for r in rows], np.int64), counts.get(1, 0) / total)


def score(docs: DataFrame, index: Index, evidence: bool = True) -> DataFrame:
    """doc_id and score of every row, with the neighbours (ids and cosines) as evidence."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                    whole, before, stems, stems_before = term_hashes(data, bounds)
                    scores, ids, cosines = [], [], []
                    for k in range(hi - lo):
                        s, best, cos = index.score(*index.vector(whole[before[k] : before[k + 1]], stems[stems_before[k] : stems_before[k + 1]]))
                        scores.append(min(max(s, 0.0), 1.0))
                        ids.append(index.ids[best] if evidence else [])
                        cosines.append(cos if evidence else [])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double, evidence array<long>, cosines array<double>")


def reject(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that score under the threshold."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, bounds in blocks.chunks(batch.column(at)):
                    whole, before, stems, stems_before = term_hashes(data, bounds)
                    clean = [index.score(*index.vector(whole[before[k] : before[k + 1]], stems[stems_before[k] : stems_before[k + 1]]))[0] < threshold for k in range(hi - lo)]
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
