"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of the training tokens in document
partitions: a row per block of documents with, for every indexed term, the
sorted word positions in that block. ``search`` orders each phrase's terms by
corpus frequency, starts from the offset-adjusted list of the rarest and
intersects it with the next lists in turn; what is left are exact phrase
matches. ``proximity`` intersects the same lists with a slack. Terms are words,
spelled out; no match rests on a hash.

Only terms of the phrases are indexed while these are at most ``SLICE``, else
all terms. Phrases are gathered and broadcast in slices of at most ``SLICE``,
one after the other, so driver and broadcast are bounded whatever the number of
phrases: more phrases mean more passes over the stored index, whose stored hits
are then united.

Results for odd input: null or empty text has no words and no hits; repeated
rows are judged one by one; a null doc_id stays null; an item without words is
no window and an item with null id is not counted; empty benchmark or documents
give zero hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import store

WINDOW = 10
SLICE = 200_000
_INDEX = "uid string, doc_ids array<long>, before binary, terms array<binary>, bounds binary, positions binary"


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct lower-cased words, the place of every word among them, how many words precede each document)."""
    data = blocks.LOWER[data]
    starts, ends, before = blocks.words(data, bounds, blocks.ALNUM_WORDS)
    with np.errstate(over="ignore"):
        first, back = blocks.distinct_spans(data, starts, ends)
    return blocks.spelled(data, starts[first], ends[first]), back, before


def phrase_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, terms): every run of ``size`` words of an item, or all its words if fewer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                known, back, before = _words(data, bounds)
                items, terms = [], []
                for k in range(hi - lo):
                    own = [known[j] for j in back[before[k] : before[k + 1]]]
                    for at in range(max(1, len(own) - size + 1) if own else 0):
                        items.append(ids[lo + k])
                        terms.append(own[at : at + size])
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    return benchmark.select(F.col(id_col).cast("long").alias("item"), text_col).mapInArrow(cut, "item long, terms array<binary>")


def build_index(docs: DataFrame, terms: set[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the given terms, or of all terms, a row per block of documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                known, back, before = _words(data, bounds)
                wanted = [k for k, w in enumerate(known) if terms is None or w in terms]
                rank = np.full(len(known) + 1, -1)
                rank[wanted] = np.arange(len(wanted))
                rank = rank[back]
                at = np.flatnonzero(rank >= 0)
                order = at[np.argsort(rank[at], kind="stable")]
                first = np.searchsorted(rank[order], np.arange(len(wanted) + 1))
                cols = [ids[lo:hi], before.tobytes(), [known[k] for k in wanted], first.astype(np.int64).tobytes(), order.astype(np.int32).tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([c], k) for c, k in zip(cols, kinds, strict=True))], names=["uid", "doc_ids", "before", "terms", "bounds", "positions"])

    return store(docs.select(F.col(id_col).cast("long").alias("d"), text_col).mapInArrow(index, _INDEX), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each indexed term stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, b in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(np.frombuffer(b, np.int64)))], names=["term", "n"])

    return index.select("terms", "bounds").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Postings:
    """One stored block, opened for intersection."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.before = np.frombuffer(row["before"], np.int64)
        self.terms, self.bounds = row["terms"], np.frombuffer(row["bounds"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        self.stride = int(self.before[-1]) + 1
        rank = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds))
        self.keys = rank * self.stride + self.positions  # sorted: rank first, then position

    def ranks(self, places: dict[bytes, int]) -> np.ndarray:
        """For each of the words in places, its rank in this block's dictionary, -1 if absent."""
        out = np.full(len(places), -1)
        for rank, word in enumerate(self.terms):
            at = places.get(word)
            if at is not None:
                out[at] = rank
        return out

    def starts(self, ranks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start): all places where every term of a phrase stands at its offset.

        ranks (of terms in this block) and offsets hold a phrase per row, rarest term first.
        """
        alive = np.flatnonzero((ranks >= 0).all(axis=1))
        lengths = self.bounds[ranks[alive, 0] + 1] - self.bounds[ranks[alive, 0]]
        phrase = np.repeat(alive, lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = self.positions[np.repeat(self.bounds[ranks[alive, 0]], lengths) + step] - offsets[phrase, 0]
        phrase, start = phrase[start >= 0], start[start >= 0]
        for k in range(1, ranks.shape[1]):
            want = ranks[phrase, k] * self.stride + np.minimum(start + offsets[phrase, k], self.stride - 1)
            at = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)
            phrase, start = phrase[hit], start[hit]
        width = offsets.max(axis=1)[phrase] if len(phrase) else start
        inside = np.searchsorted(self.before, start, "right") == np.searchsorted(self.before, start + width, "right")
        return phrase[inside], start[inside]


Phrase = tuple[bytes, ...]


def rarest_first(phrases: list[Phrase], places: dict[bytes, int], counts: dict[bytes, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of equal length together: (index, places of terms, offsets), each row from its rarest term on."""
    out = []
    n = np.array([counts.get(w, 0) for w in places], np.int64)
    for size in sorted({len(p) for p in phrases}):
        index = np.array([k for k, p in enumerate(phrases) if len(p) == size])
        terms = np.array([[places[w] for w in phrases[k]] for k in index])
        order = np.argsort(n[terms], axis=1, kind="stable")
        out.append((index, np.take_along_axis(terms, order, 1), order))
    return out


def search(index: DataFrame, windows: list[tuple[int | None, Phrase]], counts: dict[bytes, int], hits: bool = False) -> DataFrame:
    """Every document of the index with its exact phrase matches.

    uid and row name the document within the index; hits are the positions of
    hit words, filled only if asked for.
    """
    distinct = sorted({w for _, w in windows})
    place = {w: k for k, w in enumerate(distinct)}
    items: list[set[int]] = [set() for _ in distinct]
    for item, w in windows:
        if item is not None:
            items[place[w]].add(item)
    places = {w: k for k, w in enumerate(sorted({w for p in distinct for w in p}))}
    groups = rarest_first(distinct, places, counts)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                postings = _Postings(row)
                delta, found = np.zeros(postings.stride + 1, np.int64), {}
                ranks = postings.ranks(places)
                for index_of, terms, offsets in groups:
                    phrase, start = postings.starts(ranks[terms], offsets)
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + terms.shape[1], -1)
                    doc = np.searchsorted(postings.before, start, "right") - 1
                    for d, p in set(zip(doc.tolist(), index_of[phrase].tolist(), strict=True)):
                        found.setdefault(d, set()).update(items[p])
                marked = np.cumsum(delta[:-1]) > 0
                hit = np.concatenate([[0], np.cumsum(marked)])
                n_hit = hit[postings.before[1:]] - hit[postings.before[:-1]]
                for d in range(len(postings.ids)):
                    own = sorted(found.get(d, ()))
                    at = np.flatnonzero(marked[postings.before[d] : postings.before[d + 1]]).tolist() if hits else []
                    rows.append((row["uid"], d, postings.ids[d], int(postings.before[d + 1] - postings.before[d]), int(n_hit[d]), own, at))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:5]), *(pa.array(c, longs) for c in cols[5:])], names=["uid", "row", "doc_id", "n_words", "n_hit", "items", "hits"])

    return index.mapInArrow(match, "uid string, row long, doc_id long, n_words long, n_hit long, items array<long>, hits array<long>")


def proximity(index: DataFrame, first: str, second: str, slack: int) -> DataFrame:
    """(doc_id, position, other): occurrences of two words at most ``slack`` words apart in one document; lower-cased words are indexed."""
    pair = {first.encode(): 0, second.encode(): 1} if first != second else {first.encode(): 0}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                p = _Postings(row)
                ranks = p.ranks(pair)
                if (ranks < 0).any():
                    continue
                left, right = (p.positions[p.bounds[r] : p.bounds[r + 1]] for r in (ranks[0], ranks[-1]))
                lo, hi = np.searchsorted(right, left - slack), np.searchsorted(right, left + slack, "right")
                for x, u, v in zip(left, lo, hi, strict=True):
                    d = int(np.searchsorted(p.before, x, "right")) - 1
                    for y in right[u:v]:
                        if p.before[d] <= y < p.before[d + 1] and (x != y):
                            rows.append((p.ids[d], int(x - p.before[d]), int(y - p.before[d])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "position", "other"])

    return index.mapInArrow(near, "doc_id long, position long, other long")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = SLICE) -> DataFrame:
    """doc_id, n_words, n_hit, items (array) of every row of docs."""
    spark = docs.sparkSession
    windows = store(phrase_windows(benchmark, size=size).distinct(), "windows")
    parts = max(1, -(-windows.count() // limit))

    def gathered(k: int) -> tuple[list[tuple[int | None, Phrase]], set[bytes]]:
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == k)
        rows = [(r.item, tuple(map(bytes, r.terms))) for r in own.toLocalIterator()]
        return rows, {w for _, p in rows for w in p}

    def searched(k: int, index: DataFrame, rows: list, terms: set[bytes]) -> DataFrame:
        wanted = spark.createDataFrame([(bytearray(w),) for w in sorted(terms)], "term binary")
        frequency = {bytes(r.term): r.n for r in counts.join(wanted, "term", "left_semi").toLocalIterator()}
        return search(index, rows, frequency, parts > 1)

    if parts == 1:
        rows, terms = gathered(0)
        index = build_index(docs, terms)
        counts = store(term_counts(index), "terms")
        return searched(0, index, rows, terms)
    index = build_index(docs, None)
    counts = store(term_counts(index), "terms")
    union = store(searched(0, index, *gathered(0)), "hits")
    for k in range(1, parts):
        union = union.unionByName(store(searched(k, index, *gathered(k)), "hits"))
    merged = union.groupBy("uid", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("items").alias("items"), F.collect_list("hits").alias("hits"))
    return merged.select("doc_id", "n_words", F.size(F.array_distinct(F.flatten("hits"))).cast("long").alias("n_hit"), F.array_distinct(F.flatten("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    found = contamination(docs, benchmark, size)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
