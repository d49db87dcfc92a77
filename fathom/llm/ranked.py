"""Ranked lexical search of a stated query set by sort-based accumulation.

Every document is cut into terms once and stored with the terms that a query may
hold (a bitmap of fixed size says which; what it lets through by chance meets no
query). Documents are dealt to blocks, queries to blocks of bounded size, and a
task meets one block of each: it concatenates the (query, document, impact)
arrays of all matching terms, orders their packed keys by a radix sort of 16-bit
digits, sums equal keys by ``reduceat`` and keeps the best of each query by a
heap. Only these leave the task; one window over all blocks ranks them.

All arithmetic is on 64-bit integers but for the weight of a term. Results for
odd input: a null or empty text has no terms and is neither counted nor found;
each row is a document of its own, so repeated rows are found each; a row
without id ranks last among equal scores; rows of one query id, null included,
are one query; queries without a matching term have no rows; empty tables give
an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .scratch import parts, store

TOP = 20
#: Bits of the map of query terms, and of each of the aggregates that fill it.
MAP, PART = 1 << 20, 32768
#: Matching terms (with repeats over documents) of a block of documents, entries of a block of queries, and triples ordered at once.
DOC_ENTRIES, QUERY_ENTRIES, TRIPLES = 400_000, 100_000, 1 << 20
#: Scale of a weight and of an impact, and the two parameters of the impact.
WEIGHT, SCALE, K, B = 1000, 1_000_000_000, 12, 25
_POSTINGS = "part long, doc_id long, n long, terms array<string>, tfs array<long>"


def _terms(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, pa.ListArray, pa.ListArray, np.ndarray]]:
    """(first row, end row, terms with repeats per row, distinct terms per row, their counts, places in the map) for runs of rows."""
    for lo, hi, data, bounds in blocks.chunks(column):
        data = blocks.LOWER[data]
        starts, ends, before = blocks.words(data, bounds, blocks.ALNUM_WORDS)
        first, back = blocks.distinct_spans(data, starts, ends)
        place = (blocks.span_hashes(data, starts[first], ends[first]) % np.uint64(MAP)).astype(np.int64)
        row = np.repeat(np.arange(hi - lo), np.diff(before))
        if wanted is not None:
            held = wanted[place][back]
            row, back = row[held], back[held]
        keys, tfs = np.unique(row * max(len(first), 1) + back, return_counts=True)
        row, back = np.divmod(keys, max(len(first), 1))
        spelled = pa.array(blocks.spelled(data, starts[first], ends[first]), pa.binary()).cast(pa.string())
        offsets = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
        yield lo, hi, np.diff(before), pa.ListArray.from_arrays(offsets, spelled.take(pa.array(back))), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())), place[back]


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, _, terms, tfs, place in _terms(batch.column(1), None):
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), np.diff(np.asarray(terms.offsets)))))
                yield pa.RecordBatch.from_arrays([ids, terms.flatten(), tfs.flatten(), pa.array(place)], names=["item_id", "term", "repeats", "place"])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, repeats and place (in the map) of every query."""
    kind = items.schema[id_col].dataType.simpleString()
    found = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_queries, f"item_id {kind}, term string, repeats long, place long")
    return found.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"), F.min("place").alias("place"))


def term_map(terms: DataFrame) -> np.ndarray:
    """Which of MAP places a term of terms has; MAP bits reach the driver, however many terms there are."""
    filled = terms.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    out = np.zeros(MAP, bool)
    for r in filled.collect():
        out[(r.bucket - 1) * PART : r.bucket * PART] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little").astype(bool)
    return out


def postings(docs: DataFrame, wanted: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs (the wanted terms and how often) and part (a number of the run it came with) of every row."""
    bits = np.packbits(wanted).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, runs = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), 0
        task = TaskContext.get().partitionId()
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, n, terms, tfs, _ in _terms(batch.column(1), mine):
                    part, runs = (task << 32) + runs, runs + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part)), batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), terms, tfs], names=["part", "doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, _POSTINGS)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned 64-bit keys, by stable sorts of their 16-bit digits from the lowest."""
    order, top, shift = None, int(keys.max(initial=0)), 0
    while order is None or top >> shift:
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
        shift += 16
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score): sums of impacts over equal pairs, in order of item and doc."""
    if not len(item):
        return item, doc, impact
    least, span = item.min(), doc.max() + 1
    keys = ((item - least) * span + doc).astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order].astype(np.int64)
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads] // span + least, keys[heads] % span, np.add.reduceat(impact[order], heads)


def best(doc: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> list[int]:
    """Places of the top scores above 0, equal scores by id."""
    if len(score) > top:
        least = max(int(np.partition(score, len(score) - top)[len(score) - top]), 1)
        kept = np.flatnonzero(score >= least)
    else:
        kept = np.flatnonzero(score > 0)
    return heapq.nsmallest(top, kept.tolist(), key=lambda k: (-int(score[k]), int(ids[doc[k]])))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], .., hi[0] - 1, lo[1], .., hi[1] - 1 and so on."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _search(total: int, length: int, top: int, kind: pa.DataType):
    """A function of a block of documents and a block of queries that gives the best documents of each query within the block."""

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        queries = queries.sort_by([("item_id", "ascending")])
        items = queries.column("item_id").combine_chunks()
        if len(queries) and len(docs):
            lists = docs.column("terms").combine_chunks()
            ids = docs.column("doc_id").combine_chunks()
            lone = np.asarray(ids.is_null())
            rank = np.asarray(ids.fill_null(0))
            rank = np.where(lone, 2**63 - 1, rank)
            terms = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(docs)), np.diff(np.asarray(lists.offsets)))
            tf = np.asarray(docs.column("tfs").combine_chunks().flatten())
            sizes, back = np.unique(np.asarray(docs.column("n").combine_chunks()), return_inverse=True)
            m = np.array([100 - B + B * int(n) * total // length for n in sizes], np.int64)[back]
            impact = SCALE * tf // (1000 * tf + K * m[doc])
            term = np.asarray(terms.indices).astype(np.int64)
            order = radix_order(term.astype(np.uint64))
            doc, impact, bounds = doc[order], impact[order], np.searchsorted(term[order], np.arange(len(terms.dictionary) + 1))
            code = np.asarray(pc.index_in(queries.column("term").combine_chunks(), terms.dictionary).fill_null(-1)).astype(np.int64)
            weight = np.asarray(queries.column("weight").combine_chunks()) * np.asarray(queries.column("repeats").combine_chunks())
            number = np.asarray(items.dictionary_encode("encode").indices)
            met = np.flatnonzero(code >= 0)
            lo, hi = bounds[code[met]], bounds[code[met] + 1]
            cut = np.flatnonzero(np.diff(number[met], prepend=-1))  # the first entry of each query
            held, at = np.add.reduceat(hi - lo, cut) if len(cut) else np.zeros(0, np.int64), 0
            reach, cut = np.cumsum(held), np.append(cut, len(met))
            while at < len(held):
                done = int(reach[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(reach, done + TRIPLES, "right")))
                part = slice(cut[at], cut[end])
                taken = _ranges(lo[part], hi[part])
                many = hi[part] - lo[part]
                query, found, score = accumulate(np.repeat(number[met][part], many), doc[taken], impact[taken] * np.repeat(weight[met][part], many))
                edges = np.append(np.flatnonzero(np.diff(query, prepend=-1)), len(query))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    out += [(int(query[a]), int(found[a + k]), int(score[a + k])) for k in best(found[a:b], score[a:b], rank, top)]
                at = end
            first = np.flatnonzero(np.diff(number, prepend=-1))
            asked = items.take(pa.array(first[[q for q, _, _ in out]], pa.int64())) if out else items.slice(0, 0)
            got = ids.take(pa.array([d for _, d, _ in out], pa.int64()))
        else:
            asked, got = pa.array([], kind), pa.array([], pa.int64())
        return pa.table({"item_id": asked, "doc_id": got, "score": pa.array([s for _, _, s in out], pa.int64())})

    return search


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of every query."""
    spark = docs.sparkSession
    asked = store(query_terms(items, item_col, text_col), "query-terms")
    held = store(postings(docs, term_map(asked), doc_col, text_col), "postings", "zstd")
    counted = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("entries")).first()
    total, length = counted.total, counted.length or 0

    frequency = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(2 * total + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known = store(asked.join(frequency, "term").select("item_id", "term", "repeats", weight.alias("weight")), "weighted")

    doc_blocks = parts(spark, counted.entries or 0, DOC_ENTRIES)
    query_blocks = max(1, -(-known.count() // QUERY_ENTRIES))
    dealt = held.where(F.size("terms") > 0).withColumn("block", F.expr(f"pmod(xxhash64(part, doc_id), {doc_blocks}L)"))
    dealt = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("queries"), "doc_id", "n", "terms", "tfs")
    every = known.withColumn("queries", F.expr(f"pmod(xxhash64(item_id), {query_blocks})").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(doc_blocks - 1).cast("long"))))
    kind = known.schema["item_id"].dataType
    found = dealt.groupBy("block", "queries").cogroup(every.groupBy("block", "queries")).applyInArrow(_search(total, max(length, 1), top, to_arrow_type(kind)), f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
