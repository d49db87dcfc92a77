"""Subword lattice likelihood of whole documents.

Every distinct word of the corpus is scored once. Its lattice has an arc for
each byte span that an existing subword vocabulary holds (white space belongs to
the word it precedes) and for each single byte; a log-space forward recursion
adds up all segmentations. The vocabulary's own scores weight the arcs: pieces
of a merge vocabulary are scored by rank, which is read as a Zipf weight
1 / (rank + ``RANK_SHIFT``). ``ROUNDS`` passes of forward-backward counts over
all training words then adapt these weights, mixed with the vocabulary's own.

A word's probability joins its training count and its lattice: counts are
discounted by ``DISCOUNT`` each, and the freed mass goes to the lattice.
Word counts, types and arcs grow with the corpus; none is sampled.

Documents are dealt to shards of about ``SHARD_BYTES`` by a hash of id and text.
Shards send their distinct words with counts, words are counted and scored once,
and each shard gets the values of its own words back; so a frequent word is one
row per shard. Words are told apart by their bytes, never by a hash alone, and
are never collected; only the vocabulary-sized arc counts reach the driver.
A word of any length takes constant memory beside its bytes.
``lattice_score`` is the pure marginal over segmentations, without the counts.

Results for odd input: null or empty text is one end token; repeated rows each
count and are scored; a null doc_id is a training row; an empty table gives no
rows; without training rows counts are 0 and every word is scored by the lattice
alone; other columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import parts, store, total_bytes

VOCABULARY = os.environ.get("FATHOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RANK_SHIFT = 10.0
ROUNDS = 1
KEEP = 0.02
DISCOUNT = 0.75
LONG = 48
SPAN = 1 << 14
SHARD_BYTES = 32 << 20


class Pieces:
    """A subword vocabulary as byte spans with log weights; " " stands for the piece mark."""

    def __init__(self, spans: list[bytes], weights: np.ndarray):
        self.spans = spans
        self.hashes = np.array([hash_of(s) for s in spans], np.uint64)
        self.order = np.argsort(self.hashes)
        self.hashes = self.hashes[self.order]
        self.log = np.log(weights / weights.sum())
        self.longest = max(map(len, spans))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among spans, -1 if none; a table by leading bits, then exact."""
        bits = np.uint64(64 - 18)
        if not hasattr(self, "_first"):
            self._first = np.searchsorted(self.hashes >> bits, np.arange(2**18 + 1, dtype=np.uint64))
            self._deep = int(np.diff(self._first).max())
        at = self._first[(h >> bits).astype(np.int64)]
        out = np.full(h.shape, -1)
        for k in range(self._deep):
            place = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[place] == h
            out[hit] = place[hit]
        return np.where(out >= 0, self.order[out], -1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def hash_of(span: bytes) -> int:
    data = np.frombuffer(span, np.uint8)
    with np.errstate(over="ignore"):
        return int(blocks.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """The sentencepiece vocabulary at path, with every byte as a piece of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        text = model.id_to_piece(i)
        span = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
        value = 1e-6 if model.is_byte(i) else 1.0 / (RANK_SHIFT - model.get_score(i))
        weight[span] = weight.get(span, 0.0) + value
    for b in range(256):
        weight.setdefault(bytes([b]), 1e-6)
    spans = sorted(weight)
    return Pieces(spans, np.array([weight[s] for s in spans]))


def _span_table(words: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece or -1 per row) of equally long words, by start and then end."""
    size = words.shape[1]
    for start in range(size):
        h = np.zeros(len(words), np.uint64)
        for length in range(1, min(pieces.longest, size - start) + 1):
            h = h + blocks.byte_values(length - 1, words[:, start + length - 1])
            yield start, start + length, pieces.find(blocks.mix(h + np.uint64(length)))


def lattice(words: np.ndarray, pieces: Pieces, counts: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """ln of the summed weight of all segmentations of equally long words (rows of bytes).

    With counts, each arc's expected use is added to out.
    """
    n, size = words.shape
    log = np.append(pieces.log, -np.inf)
    arcs = []
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0
    for start, end, piece in _span_table(words, pieces):
        rows = np.flatnonzero(piece >= 0)
        if len(rows):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + log[piece[rows]])
            if out is not None:
                arcs.append((start, end, rows, piece[rows]))
    if out is not None:
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        for start, end, rows, piece in reversed(arcs):
            step = log[piece] + beta[end, rows]
            beta[start, rows] = np.logaddexp(beta[start, rows], step)
            np.add.at(out, piece, counts[rows] * np.exp(alpha[start, rows] + step - alpha[size, rows]))
    return alpha[size]


def _arcs(word: np.ndarray, pieces: Pieces, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all arcs that end in (lo, hi] or start in [lo, hi)."""
    first = max(0, lo + 1 - pieces.longest)
    part = word[first : hi + pieces.longest - 1]
    h = np.zeros(hi - first, np.uint64)
    found = []
    for length in range(1, min(pieces.longest, len(part)) + 1):
        n = min(hi - first, len(part) - length + 1)
        h = h[:n] + blocks.byte_values(length - 1, part[length - 1 : length - 1 + n])
        piece = pieces.find(blocks.mix(h + np.uint64(length)))
        own = np.flatnonzero(piece >= 0)
        found.append((own + first, own + first + length, piece[own]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _fill(values: list[float], places: np.ndarray, sources: np.ndarray, logs: np.ndarray) -> None:
    """Sets values at each place to ln of the summed exp(value at source + log) of its arcs; arcs of a place adjoin, in working order."""
    at, steps = -1, []

    def settle() -> None:
        top = max(steps)
        values[at] = top + math.log(sum(math.exp(x - top) for x in steps)) if top > -math.inf else top

    for place, source, log in zip(places.tolist(), sources.tolist(), logs.tolist(), strict=True):
        if place != at:
            if steps:
                settle()
            at, steps = place, []
        steps.append(values[source] + log)
    if steps:
        settle()


def long_lattice(word: np.ndarray, pieces: Pieces, count: float = 0.0, out: np.ndarray | None = None) -> float:
    """The same for one long word, ``SPAN`` bytes at a time.

    The forward values of ``longest`` positions are all that a span hands on.
    For the expected uses, these are kept for each span, from which the backward
    pass makes the forward values of a span again.
    """
    size, reach = len(word), pieces.longest
    none = -math.inf

    def forward(arcs: tuple[np.ndarray, ...], lo: int, hi: int, head: list[float]) -> list[float]:
        """Forward values at positions lo + 1 - reach to hi, the first of them given."""
        own = np.flatnonzero((arcs[1] > lo) & (arcs[1] <= hi))
        start, end, piece = (x[own[np.argsort(arcs[1][own], kind="stable")]] for x in arcs)
        alpha = head + [none] * (hi - lo)
        _fill(alpha, end - lo + reach - 1, start - lo + reach - 1, pieces.log[piece])
        return alpha

    def level(values: list[float]) -> tuple[list[float], float]:
        """The values less their greatest, and that: small numbers keep their digits over millions of positions."""
        top = max(values)
        return ([x - top for x in values], top) if top > none else (values, 0.0)

    spans = [(lo, min(lo + SPAN, size)) for lo in range(0, size, SPAN)]
    head, before = [none] * (reach - 1) + [0.0], 0.0
    heads = []
    for lo, hi in spans:
        if out is not None:
            heads.append((head, before))
        head, top = level(forward(_arcs(word, pieces, lo, hi), lo, hi, head)[-reach:])
        before += top
    total = before + head[-1]
    if out is None or total == none:
        return total
    tail, after = [0.0] + [none] * (reach - 1), 0.0
    for (lo, hi), (head, before) in zip(reversed(spans), reversed(heads), strict=True):
        arcs = _arcs(word, pieces, lo, hi)
        alpha = np.array(forward(arcs, lo, hi, head)[reach - 1 :])
        own = np.flatnonzero(arcs[0] >= lo)
        start, end, piece = (x[own[np.argsort(-arcs[0][own], kind="stable")]] for x in arcs)
        beta = [none] * (hi - lo) + tail
        _fill(beta, start - lo, end - lo, pieces.log[piece])
        share = alpha[start - lo] + pieces.log[piece] + np.array(beta)[end - lo] + (before + after - total)
        np.add.at(out, piece, count * np.exp(share))
        tail, top = level(beta[:reach])
        after += top
    return total


def word_lattices(words: list[bytes], pieces: Pieces, counts: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """ln lattice weight of each word, with its leading mark."""
    result = np.empty(len(words))
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for size in np.unique(lengths):
            own = order[np.searchsorted(lengths[order], size) : np.searchsorted(lengths[order], size, "right")]
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                if size > LONG:
                    for k in part:
                        result[k] = long_lattice(np.frombuffer(b" " + words[k], np.uint8), pieces, 0.0 if counts is None else counts[k], out)
                    continue
                flat = np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), size + 1)
                result[part] = lattice(flat, pieces, None if counts is None else counts[part], out)
    return result


def held_out(doc_id: Column, of: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def _shard_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, word, n): distinct words of each run of documents, n counted in training rows."""
    for batch in batches:
        shard, train = np.asarray(batch.column(0)), ~np.asarray(batch.column(2).cast(pa.uint8())).astype(bool)
        for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
            data = blocks.LOWER[data]
            starts, ends, before = blocks.words(data, bounds, blocks.BLANK_WORDS)
            sizes = np.diff(before)
            own, counted = np.repeat(shard[lo:hi], sizes), np.repeat(train[lo:hi], sizes)
            for s in np.unique(shard[lo:hi]):
                here = np.flatnonzero(own == s)
                with np.errstate(over="ignore"):
                    first, back = blocks.distinct_spans(data, starts[here], ends[here])
                n = np.bincount(back, counted[here], len(first)).astype(np.int64)
                own_words = blocks.spelled(data, starts[here[first]], ends[here[first]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), s, np.int64)), pa.array(own_words, pa.binary()), pa.array(n)], names=["shard", "word", "n"])


def adapt(words: DataFrame, pieces: Pieces) -> Pieces:
    """One forward-backward pass over all training words, each as often as it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(pieces.spans))
        for batch in batches:
            word_lattices(batch.column(0).to_pylist(), pieces, np.asarray(batch.column(1)).astype(float), out)
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], names=["piece", "n"])

    used = words.where("n > 0").select("word", "n").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    if not len(used):
        return pieces
    share = np.zeros(len(pieces.spans))
    share[used.piece.to_numpy()] = used.n.to_numpy()
    return Pieces(pieces.spans, (1 - KEEP) * share / share.sum() + KEEP * np.exp(pieces.log))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def likelihood(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = parts(docs.sparkSession, total_bytes(named, "text"), SHARD_BYTES)
    named = named.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long").alias("shard"), "text", held_out(F.col("doc_id")).alias("held"), "doc_id")
    named = named.repartition("shard")
    lists = store(named.mapInArrow(_shard_words, "shard long, word binary, n long").groupBy("shard", "word").agg(F.sum("n").alias("n")), "shard-words")
    words = store(lists.groupBy("word").agg(F.sum("n").alias("n")), "words")
    head = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = docs.where(~held_out(F.col("doc_id"))).count()
    total, types = (head.n or 0) + ends, (head.v or 0) + (ends > 0)

    pieces = load_pieces(path)
    for _ in range(rounds):
        pieces = adapt(words, pieces)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pure = word_lattices(batch.column(0).to_pylist(), pieces)
            ln = pure
            if total:
                seen = np.maximum(np.asarray(batch.column(1)) - DISCOUNT, 1e-300) / total
                ln = np.logaddexp(np.log(seen), np.log(DISCOUNT * types / total) + pure)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ln / np.log(10)), pa.array(pure / np.log(10))], names=["word", "n", "log", "pure"])

    values = words.select("word", "n").mapInArrow(weigh, "word binary, n long, log double, pure double")
    replies = lists.select("shard", "word").join(values, "word").select("shard", "word", "n", "log", "pure")

    end_base = np.log10((ends + 1) / (total + types + 1))
    end_log = np.log10(max(ends - DISCOUNT, 0.25) / max(total, 1))

    def score(docs: pa.Table, values: pa.Table) -> pa.Table:
        place = {w: k for k, w in enumerate(values.column("word").to_pylist())}
        n, log, pure = (np.asarray(values.column(c).combine_chunks()) if values.num_rows else np.zeros(0) for c in ("n", "log", "pure"))
        base = np.log10((n + 1) / (total + types + 1))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, data, bounds in blocks.chunks(docs.column("text")):
            data = blocks.LOWER[data]
            starts, ends_, before = blocks.words(data, bounds, blocks.BLANK_WORDS)
            with np.errstate(over="ignore"):
                first, back = blocks.distinct_spans(data, starts, ends_)
            at = np.array([place[w] for w in blocks.spelled(data, starts[first], ends_[first])], np.int64)[back]
            sums = [np.concatenate([[0], np.cumsum(x[at])])[before] for x in (n > 0, base, log, pure)]
            known, *rest = (np.diff(x) for x in sums)
            for col, x in zip(out, (np.diff(before) + 1, known + (ends > 0), *(x + e for x, e in zip(rest, (end_base, end_log, end_log), strict=True))), strict=True):
                col.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        whole = (cols[0].astype(np.int64), cols[1].astype(np.int64), np.full(len(cols[0]), total, np.int64), *(c.astype(float) for c in cols[2:]))
        return pa.table([docs.column("doc_id"), docs.column("held"), *map(pa.array, whole)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return named.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(score, _SCORES)
