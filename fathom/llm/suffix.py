"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``SIZE`` bytes that covers it also starts earlier
(smaller doc_id, or earlier in the same document), judged on the input.

Suffixes are dealt out without loss: each window of SIZE bytes belongs to the
rightmost of its smallest ``GRAM``-byte hashes, its anchor, and neighbouring
windows with one anchor travel as one piece of text. Equal windows have equal
anchors, so they meet in the same bucket. Anchors that occur once in the corpus
are dropped on count alone, and equal pieces (by a 128-bit digest) collapse to
the earliest, first within a shard of documents and then across shards, before
anything is sorted; where all pieces of an anchor are alike (least and greatest
hash agree), their digests are all that travels. An anchor of more than ``HOT`` pieces is split further: its
distinct pieces go as digests of single windows, dealt by anchor and window, so
the most frequent passage is no group of its own and only equal windows meet.

Each shard of documents transforms its own pieces and ships, per bucket of
anchors, their Burrows-Wheeler transform (the byte before each position, in the
order of the strings that start there, cyclic within a piece) and the rank of
each piece's start, and no text. A bucket's task walks back through each
transform, which gives its text and order, and ``merge``s them: every round
orders all positions by the two bytes before them, stably, which extends the
settled context by two and keeps each shard's own order. From ``MERGED`` bytes
on only unsettled runs, whose neighbours still agree, are refined, by the place
of the position one context further; so the settled context doubles, and no
suffix is compared or sorted anew. The places after each round give the common
prefixes of neighbours; runs that share SIZE bytes are the repeated intervals.

Shards and buckets are counted by bytes (``SHARD_BYTES``, ``COLLECTION``), so a
task's memory doesn't follow the corpus.

Results for odd input: null or empty text has no bytes and no spans; texts
shorter than SIZE lose nothing; rows with one doc_id and equal text stand at the
same places, so neither makes the other repeated; rows with one doc_id or none
and different texts are documents of their own, in the order of a hash of the
text (``sub``, 0 for an id that no other row has); a null doc_id counts as the
smallest possible id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .scratch import parts, total_bytes

SIZE = 100
GRAM = 32
STEP = 2
MERGED = 16
COLLECTION = 1 << 20
#: Pieces of one anchor that surely fit a collection.
HOT = COLLECTION // (2 * SIZE - GRAM + 1)
SHARD_BYTES = 8 << 20
#: How pieces of an anchor travel: as digests only, as text, as digests of single windows.
ALIKE, WHOLE, SPLIT = 0, 1, 2
_PLACE_BITS = np.uint64(32)
_LISTS = {"key": "long", "digest": "long", "tail": "long", "doc_id": "long", "sub": "long", "at": "int", "windows": "int", "start": "int"}
_BUNDLE = f"bucket long, {', '.join(f'{c} array<{t}>' for c, t in _LISTS.items())}, transform binary"


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, document, hash of the whole) of every run of windows with one anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SIZE:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    grams = blocks.rolling_hashes(data, GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (grams & ~low) | (low - place)
    span, reach = SIZE - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (low - (least & low)).astype(np.int64)
    sizes = np.diff(bounds)
    inside = np.zeros(n + 1, np.int64)
    fits = sizes >= SIZE
    inside[bounds[:-1][fits]] += 1
    np.add.at(inside, bounds[1:][fits] - SIZE + 1, -1)
    valid = np.cumsum(inside[: len(anchor)]) > 0
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[bounds[:-1][bounds[:-1] < len(anchor)]] = True
    change[1:] |= valid[1:] != valid[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(anchor))
    rank = np.arange(len(anchor), dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)
    summed = np.concatenate([[np.uint64(0)], np.cumsum(blocks.mix(grams[: len(anchor)] + rank * np.uint64(blocks.MULTIPLIER)))])
    starts, ends = starts[valid[starts]], ends[valid[starts]]
    whole = summed[ends] - summed[starts] + (ends - starts).astype(np.uint64)
    for step in (GRAM, 2 * GRAM, SIZE - GRAM):  # the rest of the last window
        whole = blocks.mix(whole) + grams[ends - 1 + step]
    return starts, ends - starts, grams[anchor[starts]], np.searchsorted(bounds, starts, "right") - 1, whole


class Layout:
    """Pieces in a row, each followed by STEP zero bytes, with the ways back from each position, cyclic within its piece."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        self.text, self.sizes, self.least = text, sizes, int(sizes.min(initial=1 << 30))
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.size = np.repeat(sizes.astype(np.int32), sizes)
        self.start = np.repeat(self.first.astype(np.int32), sizes)
        self.within = np.arange(len(text), dtype=np.int32) - self.start

    def two_back(self) -> tuple[np.ndarray, np.ndarray]:
        """(the position two bytes before each, the two bytes between)."""
        last = self.ahead(-STEP)
        return last, self.text[last].astype(np.uint16) << np.uint16(8) | self.text[self.ahead(-1)]

    def ahead(self, step: int, of: np.ndarray | None = None) -> np.ndarray:
        """The position step bytes on, cyclic within the piece, of some positions or of all."""
        start, size, then = (self.start, self.size, self.within) if of is None else (self.start[of], self.size[of], self.within[of])
        then = then + np.int32(step)
        if step < 0:
            then[then < 0] += size[then < 0]
        elif step <= self.least:  # once around at most
            then -= size * (then >= size)
        else:
            then %= size
        then += start
        return then


def cyclic_order(laid: Layout) -> np.ndarray:
    """The positions in the order of the endless strings that start there, equal ones by position.

    First by eight bytes, then those that still agree by the place of the
    position as far on as is settled, which doubles each time.
    """
    key, context = laid.text.astype(np.uint64), 1
    while context < 8:
        key = key << np.uint64(8 * context) | key[laid.ahead(context)]
        context *= 2
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    place = np.empty(len(order), np.int64)
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = ~new
    tied[:-1] |= ~new[1:]
    alive = order[tied]
    while len(alive) and context < 2 * int(laid.sizes.max()):
        key = place[alive] << 32 | place[laid.ahead(context, alive)]
        by = np.argsort(key)
        alive, key = alive[by], key[by]
        run, new = key >> 32, np.concatenate([[True], key[1:] != key[:-1]])
        first = np.concatenate([[True], run[1:] != run[:-1]])
        count = np.arange(len(alive))
        place[alive] = run + np.maximum.accumulate(np.where(new, count, 0)) - np.maximum.accumulate(np.where(first, count, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        alive = alive[tied]
        context *= 2
    if len(alive):
        return np.argsort(place, kind="stable")
    order[place] = np.arange(len(place))
    return order


def transform(laid: Layout, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of each group of neighbouring pieces, one after the other.

    That is the byte before each position, in the order of the strings that
    start there, and the rank of each piece's start within its group.
    """
    order = cyclic_order(laid)
    order = order[np.argsort(group[laid.owner[order]], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    heads = np.concatenate([[True], group[1:] != group[:-1]])
    return laid.text[laid.ahead(-1)[order]], rank[laid.first] - laid.first[heads][np.cumsum(heads) - 1]


def restore(turned: list[np.ndarray], start: np.ndarray, sizes: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text, orders) of transforms, by walking back from the start of every piece at once; pieces is how many each transform has."""
    bases = np.cumsum([len(t) for t in turned]) - [len(t) for t in turned]
    back = np.empty(sum(map(len, turned)), np.int64)
    for base, t in zip(bases.tolist(), turned, strict=True):
        back[base + np.argsort(t, kind="stable")] = np.arange(base, base + len(t))
    flat, at = np.concatenate(turned), start + np.repeat(bases, pieces)
    text, rank = np.empty(len(flat), np.uint8), np.empty(len(flat), np.int64)
    ends = np.cumsum(sizes)
    for step in range(1, int(sizes.max()) + 1):
        own = np.flatnonzero(sizes >= step)
        text[ends[own] - step] = flat[at[own]]
        at[own] = back[at[own]]
        rank[ends[own] - step] = at[own]
    order = np.full(len(flat), -1)
    order[rank] = np.arange(len(flat))
    orders, piece = [], 0
    for base, t, n in zip(bases.tolist(), turned, pieces.tolist(), strict=True):
        own = order[base : base + len(t)]
        if (own < 0).any():  # a piece of whole periods visits some ranks twice
            own = base + cyclic_order(Layout(text[base : base + len(t)], sizes[piece : piece + n]))
        orders.append(own)
        piece += n
    return text, orders


def merge(laid: Layout, transforms: list[np.ndarray]) -> np.ndarray:
    """The place of each position among all transforms, interleaved by their first MERGED bytes; equal bytes, equal places."""
    positions = np.concatenate(transforms)
    last, before = laid.two_back()
    block = np.zeros(len(positions), np.int32)
    for _ in range(MERGED // STEP):
        key = before[positions]
        order = np.argsort(key, kind="stable")
        key, block = key[order], block[order]
        differs = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        positions = last[positions[order]]
        block = np.cumsum(differs, dtype=np.int32)
    place = np.empty(len(positions), np.int32)
    place[positions] = np.flatnonzero(differs)[block - 1]
    return place


def refine(place: np.ndarray, wanted: np.ndarray, further: np.ndarray) -> None:
    """Settle runs of equal place among wanted by the place of the further positions."""
    alive = np.bincount(place[wanted], minlength=len(place))[place[wanted]] > 1
    own, ahead = wanted[alive], further[alive]
    key = place[own].astype(np.int64) << 32 | place[ahead]
    order = np.argsort(key)
    key, own = key[order], own[order]
    if len(own):
        run, sub = key >> 32, np.concatenate([[True], key[1:] != key[:-1]])
        first = np.concatenate([[True], run[1:] != run[:-1]])
        count = np.arange(len(own))
        shift = np.maximum.accumulate(np.where(sub, count, 0)) - np.maximum.accumulate(np.where(first, count, 0))
        place[own] = (run + shift).astype(np.int32)


def intervals(laid: Layout, transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions of whole windows in merged order, bytes that each shares with the one before it).

    Shared bytes are given in the steps of refinement: 0, MERGED, 2 and 4 times MERGED, or SIZE.
    """
    place = merge(laid, transforms)
    room = laid.size - STEP - laid.within
    every = np.arange(len(laid.text))
    whole = every[room >= SIZE]
    settled = [(MERGED, place[whole])]
    for context, step in ((MERGED, MERGED), (2 * MERGED, 2 * MERGED), (4 * MERGED, SIZE - 4 * MERGED)):
        fits = every[room >= context + step]
        refine(place, fits, fits + step)
        settled.append((context + step, place[whole]))
    order = np.argsort(place[whole], kind="stable")
    shared = np.zeros(len(whole), np.int64)
    for context, then in settled:
        shared[1:][then[order[1:]] == then[order[:-1]]] = context
    return whole[order], shared


def repeated_starts(laid: Layout, transforms: list[np.ndarray], rank: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows stand earlier too; rank and at say where a piece starts (document order, byte)."""
    flags = np.zeros(len(laid.text), bool)
    positions, shared = intervals(laid, transforms)
    if len(positions):
        place = rank[laid.owner[positions]].astype(np.int64) << 36 | (at[laid.owner[positions]] + laid.within[positions])
        heads = np.flatnonzero(shared < SIZE)
        earliest = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(place))))
        flags[positions] = place > earliest
    return [flags[f : f + s - STEP - SIZE + 1] for f, s in zip(laid.first, laid.sizes, strict=True)]


def _shard_rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of a shard's documents, in runs."""
    for lo, _, data, bounds in blocks.chunks(table.column("text")):
        yield lo, data, bounds


def _names(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, sub) of a shard's rows: sub tells apart different texts of one id."""
    ids, sub = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "sub"))
    _, back, n = np.unique(ids, return_inverse=True, return_counts=True)
    shared = (n[back] > 1) & (ids != NULL_ID)
    if shared.any():
        with np.errstate(over="ignore"):
            digests = np.concatenate([blocks.signed(blocks.span_hashes(data, bounds[:-1], bounds[1:])) for _, data, bounds in _shard_rows(table)])
        sub = np.where(shared, digests, sub)
    return ids, sub


def _ranks(ids: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each document among the distinct ones in order, their ids, their subs)."""
    order = np.lexsort((sub, ids))
    ids, sub = ids[order], sub[order]
    new = np.ones(len(order), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (sub[1:] != sub[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, ids[new], sub[new]


def _anchors(table: pa.Table) -> pa.Table:
    """(shard, key, n, lo, hi): how many pieces of an anchor the shard has, and the least and greatest hash of them."""
    keys, whole = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for _, data, bounds in _shard_rows(table):
            found = _pieces(data, bounds)
            keys.append(found[2])
            whole.append(found[4])
    key, whole = blocks.signed(np.concatenate(keys)), blocks.signed(np.concatenate(whole))
    order = np.argsort(key)
    key, whole = key[order], whole[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    spread = (np.minimum.reduceat(whole, heads), np.maximum.reduceat(whole, heads)) if len(key) else (key, key)
    shard = table.column("shard")[0].as_py()
    return pa.table({"shard": np.full(len(heads), shard, np.int64), "key": key[heads], "n": np.diff(np.append(heads, len(key))), "lo": spread[0], "hi": spread[1]})


def _covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint (document, start, end) that cover the same bytes."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + number * (1 << 40)) - number * (1 << 40)
    heads = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (start[1:] > reach[:-1])]))
    return doc[heads], start[heads], reach[np.append(heads[1:], len(doc)) - 1]


def _collapsed(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that agree in all of same: (the earliest, those that start later)."""
    order = np.lexsort((at, doc, *same))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in same], axis=0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    return order[new], order[(doc[order] != doc[head]) | (at[order] != at[head])]


def _digests(texts: list[np.ndarray], run: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each span of the texts, as two numbers."""
    raw = b"".join(hashlib.blake2b(texts[r][a:b].tobytes(), digest_size=16).digest() for r, a, b in zip(run.tolist(), start.tolist(), end.tolist(), strict=True))
    pair = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _windows(key: np.ndarray, doc: np.ndarray, at: np.ndarray, start: np.ndarray, windows: np.ndarray, run: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(key, digest, tail, document, at) of every window of the given pieces; the key joins anchor and window."""
    piece = np.repeat(np.arange(len(key)), windows)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = start[piece] + step
    digest, tail = _digests(texts, run[piece], first, first + SIZE)
    return blocks.signed(blocks.mix(key.view(np.uint64)[piece] ^ blocks.mix(digest.view(np.uint64)))), digest, tail, doc[piece], at[piece] + step


def _bundles(texts: list[np.ndarray], run: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, bytes]]:
    """(bucket, its pieces, ranks of their starts, their transform) of pieces in order of bucket, some blocks.CHUNK bytes at a time."""
    sizes = end - start + STEP
    reach, gap = np.cumsum(sizes), bytes(STEP)
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(bucket))
    lo = 0
    while lo < len(heads):
        done = int(reach[heads[lo] - 1]) if heads[lo] else 0
        hi = max(lo + 1, int(np.searchsorted(reach[tails - 1], done + blocks.CHUNK, "right")))
        own = slice(int(heads[lo]), int(tails[hi - 1]))
        spans = zip(run[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True)
        text = np.frombuffer(b"".join(texts[r][a:b].tobytes() + gap for r, a, b in spans), np.uint8)
        laid = Layout(text, sizes[own])
        turned, rank = transform(laid, np.repeat(np.arange(hi - lo, dtype=np.uint16 if hi - lo < 65536 else np.int64), tails[lo:hi] - heads[lo:hi]))
        for h, t in zip(heads[lo:hi].tolist(), tails[lo:hi].tolist(), strict=True):
            a = int(laid.first[h - own.start])
            yield int(bucket[h]), slice(h, t), rank[h - own.start : t - own.start], turned[a : a + int(sizes[h:t].sum())].tobytes()
        lo = hi


def _shard_pieces(docs: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Bundles of the shard's distinct pieces whose anchor is repeated.

    Pieces that are alike wherever their anchor is, and the windows of hot
    anchors, have an empty transform: only their digests meet.
    What later equal ones within the shard cover comes as one bundle without a transform.
    """
    wanted, kind = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if replies.num_rows:
        wanted, kind = np.asarray(replies.column("key").combine_chunks()).view(np.uint64), np.asarray(replies.column("kind").combine_chunks())
        wanted, kind = wanted[np.argsort(wanted)], kind[np.argsort(wanted)]
    columns: list[list] = [[np.zeros(0, np.int64)] for _ in range(6)]
    texts: list[np.ndarray] = []
    ranked, ids, sub = _ranks(*_names(docs))
    with np.errstate(over="ignore"):
        for lo, data, bounds in _shard_rows(docs) if len(wanted) else ():
            start, windows, key, doc, _ = _pieces(data, bounds)
            rank = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = wanted[rank] == key
            start, windows, key, doc = start[hit], windows[hit], key[hit], doc[hit]
            for col, x in zip(columns, (blocks.signed(key), ranked[lo + doc], start - bounds[doc], start, windows, np.full(len(start), len(texts))), strict=True):
                col.append(x)
            texts.append(data)
    key, doc, at, start, windows, run = (np.concatenate(c) for c in columns)
    end = start + windows + SIZE - 1
    digest, tail = _digests(texts, run, start, end)
    own, later = _collapsed(doc, at, key, digest, tail)
    own_kind = kind[np.searchsorted(wanted, key[own].view(np.uint64))] if len(own) else np.zeros(0, np.int32)
    alike, own, split = own[own_kind == ALIKE], own[own_kind != ALIKE], own_kind[own_kind != ALIKE] == SPLIT
    known = [(doc[later], at[later], at[later] + windows[later] + SIZE - 1)]
    with np.errstate(over="ignore"):
        many = _windows(*(x[own[split]] for x in (key, doc, at, start, windows, run)), texts)
    first, later = _collapsed(many[3], many[4], *many[:3])
    known.append((many[3][later], many[4][later], many[4][later] + SIZE))
    local = _covered(*(np.concatenate(c) for c in zip(*known, strict=True)))

    def deal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (blocks.mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    rows: list[tuple] = []
    with np.errstate(over="ignore"):
        order, bucket = deal(key[own[~split]])
        own = own[~split][order]
        lists = [x[own] for x in (key, digest, tail, ids[doc], sub[doc], at, windows)]
        rows += [(b, *(x[p] for x in lists), rank, turned) for b, p, rank, turned in _bundles(texts, run[own], start[own], end[own], bucket)]
        plain = [np.concatenate([x[alike], y[first]]) for x, y in zip((key, digest, tail, doc, at), many, strict=True)]
        order, bucket = deal(plain[0])
        plain = [x[order] for x in plain]
    none = np.zeros(max(len(order), len(local[0])), np.int64)
    lists = [*plain[:3], ids[plain[3]], sub[plain[3]], plain[4], np.concatenate([windows[alike], none[: len(first)] + 1])[order], none[: len(order)]]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows += [(int(bucket[h]), *(x[h:t] for x in lists), b"") for h, t in itertools.pairwise([*heads.tolist(), len(bucket)])]
    if len(local[0]):
        none = none[: len(local[0])]
        rows.append((int(ids[0] % buckets), none, none, none, ids[local[0]], sub[local[0]], local[1], local[2] - local[1] - SIZE + 1, none, None))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
    kinds = [pa.int64(), *(pa.list_(pa.int64() if t == "long" else pa.int32()) for t in _LISTS.values()), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", *_LISTS, "transform"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _found(table: pa.Table) -> pa.Table:
    """(doc_id, sub, start, end): the bytes of repeated windows among the bundles of one bucket."""
    sizes = np.diff(np.asarray(table.column("windows").combine_chunks().offsets))
    key, digest, tail, ids, sub, at, windows, start = (np.asarray(table.column(c).combine_chunks().flatten()).astype(np.int64) for c in _LISTS)
    doc, ids, sub = _ranks(ids, sub)
    turned = table.column("transform").to_pylist()
    known = np.repeat([t is None for t in turned], sizes)
    out = [(doc[known], at[known], at[known] + windows[known] + SIZE - 1)]
    met = np.flatnonzero(~known)
    own, later = _collapsed(doc[met], at[met], key[met], digest[met], tail[met])
    later = met[later]
    out.append((doc[later], at[later], at[later] + windows[later] + SIZE - 1))

    here = np.flatnonzero(np.repeat([bool(t) for t in turned], sizes))
    lone = np.zeros(len(key), bool)
    lone[met[own]] = True
    lone = lone[here]
    several = np.unique(key[here[lone]], return_inverse=True, return_counts=True)
    lone[lone] = several[2][several[1]] > 1
    if lone.any():
        whole = windows[here] + SIZE - 1 + STEP
        kept = np.repeat(lone, whole)
        fresh = np.cumsum(kept) - 1
        shipped = [(np.frombuffer(t, np.uint8), n) for t, n in zip(turned, sizes, strict=True) if t]
        text, orders = restore([t for t, _ in shipped], start[here], whole, np.array([n for _, n in shipped]))
        transforms = [fresh[order[kept[order]]].astype(np.int32) for order in orders]
        pieces = here[lone]
        flags = repeated_starts(Layout(text[kept], whole[lone]), transforms, doc[pieces], at[pieces])
        for k, f in zip(pieces, flags, strict=True):
            if f.any():
                a, b = _runs(f)
                out.append((np.full(len(a), doc[k]), at[k] + a, at[k] + b + SIZE - 1))
    doc, start, end = _covered(*(np.concatenate(c) for c in zip(*out, strict=True)))
    return pa.table({"doc_id": ids[doc], "sub": sub[doc], "start": start, "end": end})


def repeated_bytes(named: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(shard, doc_id, sub, start, end) of repeated byte runs of named (shard, doc_id, sub, text); runs may overlap."""
    by_shard = named.groupBy("shard")
    anchors = by_shard.applyInArrow(_anchors, "shard long, key long, n long, lo long, hi long")
    same = Window.partitionBy("key")
    met = anchors.withColumns({"total": F.sum("n").over(same), "lo": F.min("lo").over(same), "hi": F.max("hi").over(same)}).where("total > 1")
    kind = F.when(F.col("lo") == F.col("hi"), ALIKE).when(F.col("total") > HOT, SPLIT).otherwise(WHOLE)
    replies = met.select("shard", "key", kind.cast("int").alias("kind"))
    bundles = by_shard.cogroup(replies.groupBy("shard")).applyInArrow(lambda docs, replies: _shard_pieces(docs, replies, buckets), _BUNDLE)
    met = bundles.groupBy("bucket").applyInArrow(_found, "doc_id long, sub long, start long, end long")
    return met.select(shard_of(shards), "doc_id", "sub", "start", "end")


def shard_of(shards: int):
    """The shard of a row of doc_id and sub: by the id, without one by the text."""
    return F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id") == NULL_ID, F.col("sub")).otherwise(0)), F.lit(shards)).cast("long").alias("shard")


NULL_ID = -(2**63)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row.

    With carry, also row: the row's other columns and its doc_id, as a struct;
    and kept is a string, without what cuts leave of split characters.
    """
    spark, total = docs.sparkSession, total_bytes(docs, text_col)
    shards = parts(spark, total, SHARD_BYTES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(c for c in docs.columns if c != text_col)) if carry else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), row.alias("row"))
    plain = plain.withColumn("sub", F.when(F.col("doc_id") == NULL_ID, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    named = plain.select(shard_of(shards), "doc_id", "sub", "text", "row")
    runs = repeated_bytes(named, shards, parts(spark, total, COLLECTION))

    def cut(docs: pa.Table, runs: pa.Table) -> pa.Table:
        fields = (np.asarray(runs.column(c).combine_chunks()) if runs.num_rows else np.zeros(0, np.int64) for c in ("doc_id", "sub", "start", "end"))
        owner, owner_sub, start, end = fields
        ids, sub = _names(docs)
        ranked, _, _ = _ranks(np.concatenate([ids, owner]), np.concatenate([sub, owner_sub]))
        own, owner = ranked[: len(ids)], ranked[len(ids) :]
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        rows: list[tuple] = []
        for lo_row, data, bounds in _shard_rows(docs):
            for k in range(len(bounds) - 1):
                text = data[bounds[k] : bounds[k + 1]]
                lo, hi = np.searchsorted(owner, own[lo_row + k]), np.searchsorted(owner, own[lo_row + k], "right")
                removed = spans = 0
                if lo < hi:
                    a, reach = start[lo:hi], np.maximum.accumulate(end[lo:hi])
                    fresh = np.concatenate([[True], a[1:] > reach[:-1]])
                    heads = np.flatnonzero(fresh)
                    a, b = a[heads], reach[np.append(heads[1:], len(reach)) - 1]
                    removed, spans = int((b - a).sum()), len(a)
                    text = np.concatenate([text[x:y] for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True)])
                left = text.tobytes()
                rows.append((int(bounds[k + 1] - bounds[k]), removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if carry else left))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if carry else pa.binary()]
        names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([docs.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = T.StructType([named.schema["row"]])
    for field in ("n_bytes", "n_removed", "n_spans"):
        schema.add(field, "long")
    schema = schema.add("kept_sha256", "string").add("kept", "string" if carry else "binary")
    found = named.groupBy("shard").cogroup(runs.groupBy("shard")).applyInArrow(cut, schema)
    found = found.select(F.col("row").getField(id_col if carry else "doc_id").cast("long").alias("doc_id"), *found.columns[1:], *(["row"] if carry else []))
    return found
