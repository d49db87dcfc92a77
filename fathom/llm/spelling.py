"""Spelling variants: words one edit apart, found by a forward and a backward minimal acyclic automaton.

Words of the texts are counted in tasks and summed by Spark. To find the near
words of a word, it is cut into halves: a near word keeps the first half or the
second. So words are dealt to buckets by a half that they may share with a query;
each bucket builds one automaton over its words, spelled forward where they share
a first half and backward where they share a second. A query walks its exact half
and completes the rest with one error. States carry how many words leave them, so
a walk ends in the number of the word that it spelled, by which repeats of a
query's results fall away; what keeps both halves' places counts forward only.
The words of a half that fills more than a bucket are dealt to several, all of
which its queries visit.

Results for odd input: a null or empty text has no words; a null id is spelled as
an empty one; repeated rows count each; among near words of equal count the
smallest in code-point order is the form; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import parts, store

#: An occurrence loses a code point where this divides its hash, the least length and count of a word, how often its form must occur for each of its own.
EVERY, LENGTH, COUNT, RATIO = 199, 6, 5, 5
#: Words of one automaton, about; words that a task counts before it hands them on; bytes up to which the hash of a word is put together from tables.
BUCKET, HELD, SHORT = 20_000, 100_000, 64
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # 0xC3 leads the letters from U+00C0 to U+00FF


def _crc_steps() -> np.ndarray:
    """What a byte does to the checksum, for each low byte of it."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_steps()


def _shifted(sums: np.ndarray) -> np.ndarray:
    """Checksums of prefixes moved on by 0 to SHORT bytes: what they add to the checksum of prefix and word."""
    out = np.empty((len(sums), SHORT + 1), np.uint32)
    out[:, 0] = sums
    for k in range(SHORT):
        out[:, k + 1] = _CRC[out[:, k] & np.uint32(255)] ^ (out[:, k] >> np.uint32(8))
    return out


def _pieces(data: np.ndarray, inside: np.ndarray) -> Iterator[slice]:
    """Slices of a text of about CHUNK bytes that cut no word."""
    at = 0
    while at < len(data):
        end = min(at + blocks.CHUNK, len(data))
        rest = np.flatnonzero(~inside[end : end + blocks.CHUNK]) if end < len(data) else np.zeros(0, np.int64)
        while end < len(data) and not len(rest):
            end = min(end + blocks.CHUNK, len(data))
            rest = np.flatnonzero(~inside[end : end + blocks.CHUNK]) if end < len(data) else rest
        end = end + int(rest[0]) if end < len(data) else end
        yield slice(at, end)
        at = end


def _count(ids: list[int | None], data: np.ndarray, bounds: np.ndarray, held: Counter[bytes]) -> None:
    """Add the words of a run of texts, after the deletions that their hashes ask for."""
    marks = data.copy()
    marks[1:][data[:-1] == 0xC3] = 0xC3
    for part in _pieces(data, _LETTERS[marks]) if len(ids) == 1 else [slice(0, len(data))]:
        near = np.array([0, part.stop - part.start]) if len(ids) == 1 else bounds
        own = blocks.LOWER[data[part]]
        starts, ends, before = blocks.words(marks[part], near, _LETTERS)
        if not len(starts):
            continue
        first, back = blocks.distinct_spans(own, starts, ends)
        spelled = blocks.spelled(own, starts[first], ends[first])
        prefix = [f"{'' if i is None else i}:".encode() for i in ids]
        table = _shifted(np.array([zlib.crc32(p) for p in prefix], np.uint32))
        row, size = np.repeat(np.arange(len(ids)), np.diff(before)), ends - starts
        sums = table[row, np.minimum(size, SHORT)] ^ np.array([zlib.crc32(w) for w in spelled], np.uint32)[back]
        for k in np.flatnonzero(size > SHORT).tolist():
            sums[k] = zlib.crc32(prefix[row[k]] + spelled[back[k]])
        cut = sums % np.uint32(EVERY) == 0
        whole = np.bincount(back[~cut], minlength=len(first))
        for k in np.flatnonzero(whole).tolist():
            if len(spelled[k]) >= LENGTH:
                held[spelled[k]] += int(whole[k])
        for k in np.flatnonzero(cut).tolist():
            word = spelled[back[k]].decode()
            gone = int(sums[k]) % len(word)
            held[(word[:gone] + word[gone + 1 :]).encode()] += 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter[bytes] = Counter()
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                _count(ids.slice(lo, hi - lo).to_pylist(), data, bounds, held)
                if len(held) > HELD:
                    yield handed(held)
                    held.clear()
    yield handed(held)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words long and frequent enough."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = named.mapInArrow(_words, "word string, n long").where(F.char_length("word") >= LENGTH)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; ``arcs[state]`` has target and words passed over, by label."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = [False]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.leaving: list[int] = [0]
        known: dict[tuple, int] = {}
        open_path: list[int] = [0]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(open_path, last, same, known)
            for _ in word[same:]:
                self.final.append(False)
                self.arcs.append({})
                self.leaving.append(0)
                open_path.append(len(self.final) - 1)
            self.final[open_path[-1]] = True
            last = word
        self._close(open_path, last, 0, known)
        self._number(0)

    def _close(self, path: list[int], last: str, depth: int, known: dict[tuple, int]) -> None:
        """The states of the last word beyond depth will not change: equal ones become one."""
        while len(path) > depth + 1:
            state = path.pop()
            self._number(state)
            shape = (self.final[state], tuple((c, t) for c, (t, _) in self.arcs[state].items()))
            kept = known.setdefault(shape, state)
            self.arcs[path[-1]][last[len(path) - 1]] = (kept, 0)

    def _number(self, state: int) -> None:
        """Arcs come in order of label, so an arc passes over all words of the arcs before it."""
        passed = int(self.final[state])
        for label, (target, _) in self.arcs[state].items():
            self.arcs[state][label] = (target, passed)
            passed += self.leaving[target]
        self.leaving[state] = passed

    def walk(self, text: str, state: int = 0, number: int = 0) -> tuple[int, int] | None:
        for c in text:
            step = self.arcs[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def within_one(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that start with exact and go on with rest changed by one insertion, deletion or replacement."""
        out: set[int] = set()
        at = self.walk(exact)
        k = 0
        while at is not None:
            state, number = at
            tails = [(state, number, k + 1)] if k < len(rest) else []
            for label, (target, passed) in self.arcs[state].items():
                tails.append((target, number + passed, k))
                if k < len(rest) and label != rest[k]:
                    tails.append((target, number + passed, k + 1))
            for target, so_far, after in tails:
                end = self.walk(rest[after:], target, so_far)
                if end is not None and self.final[end[0]]:
                    out.add(end[1])
            at = self.walk(rest[k], state, number) if k < len(rest) else None
            k += 1
        return out


def _near(table: pa.Table) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(word, near words with counts) of every query of a bucket, those found from the second half only where the first differs."""
    back = table.column("side")[0].as_py() == "back"
    turn = -1 if back else 1
    rows = list(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("stored").to_pylist(), table.column("asks").to_pylist(), strict=True))
    held = {w[::turn]: n for w, n, stored, _ in rows if stored}
    spelled = sorted(held)
    automaton = Automaton(spelled)
    for word in sorted({w for w, _, _, asks in rows if asks}):
        half = len(word) // 2
        turned = word[::turn]
        exact = len(word) - half if back else half
        found = [spelled[k] for k in automaton.within_one(turned[:exact], turned[exact:])]
        near = [(held[w], w[::turn]) for w in found]
        yield word, [(n, w) for n, w in near if not (back and w[:half] == word[:half])]


def _best(table: pa.Table) -> pa.Table:
    out = []
    for word, near in _near(table):
        if near:
            n, form = min(near, key=lambda x: (-x[0], x[1]))
            out.append((word, len(near), n, form))
    return pa.table({"word": pa.array([r[0] for r in out], pa.string()), "n_near": pa.array([r[1] for r in out], pa.int64()), "form_n": pa.array([r[2] for r in out], pa.int64()), "form": pa.array([r[3] for r in out], pa.string())})


def _pairs(table: pa.Table) -> pa.Table:
    out = [(word, w, n) for word, near in _near(table) for n, w in near]
    return pa.table({"word": pa.array([r[0] for r in out], pa.string()), "near": pa.array([r[1] for r in out], pa.string()), "near_n": pa.array([r[2] for r in out], pa.int64())})


def _dealt(words: DataFrame, size: int) -> DataFrame:
    """Words (word, n) by bucket, with side, known (length of the half), stored (part of the bucket's automaton) and asks (a query of the bucket).

    A bucket holds halves of one length, so what a query finds was stored under the query's own half: in one bucket only.
    """
    long = F.char_length("word")
    halves = []
    for d in (-1, 0, 1):  # a word is stored for queries shorter, as long and longer by one
        asker = long + d
        first, second = F.floor(asker / 2).cast("int"), (asker - F.floor(asker / 2)).cast("int")
        for side, text in (("fore", F.left("word", first)), ("back", F.right("word", second))):
            halves.append(F.struct(F.lit(side).alias("side"), text.alias("half"), F.lit(d == 0).alias("asks")))
    told = words.select("word", "n", F.explode(F.array(*halves)).alias("h")).select("word", "n", "h.*").groupBy("side", "half", "word", "n").agg(F.max("asks").alias("asks"))
    told = store(told, "halves")
    hot = told.groupBy("side", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > size).select("side", "half", F.ceil(F.col("rows") / size).cast("int").alias("shards"))
    spread = told.join(hot, ["side", "half"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("stored", F.col("shard") == F.expr("pmod(xxhash64(word), shards)"))
    count = parts(words.sparkSession, told.count(), size)
    bucketed = spread.where("stored or asks").withColumn("bucket", F.expr(f"pmod(xxhash64(side, half, shard), {count}L)"))
    return bucketed.select("side", F.char_length("half").alias("known"), "bucket", "word", "n", "stored", "asks").repartition(count, "side", "known", "bucket")


def near_pairs(words: DataFrame, size: int = BUCKET) -> DataFrame:
    """word, near and near_n: every ordered pair of words (word, n) that are one edit apart."""
    return _dealt(words, size).groupBy("side", "known", "bucket").applyInArrow(_pairs, "word string, near string, near_n long")


def forms(words: DataFrame, size: int = BUCKET) -> DataFrame:
    """word, n, n_near (near words), form (the most frequent near word, if frequent enough) and form_n of words (word, n)."""
    found = _dealt(words, size).groupBy("side", "known", "bucket").applyInArrow(_best, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("back"), "form")).alias("best"))
    taken = -F.col("best.back") >= RATIO * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.back")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BUCKET) -> DataFrame:
    """word, form, root (the end of its chain of forms, else the word), n, n_near and form_n of every word of the texts."""
    words = store(vocabulary(docs, id_col, text_col), "vocabulary")
    found = store(forms(words, size), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    chain = max(1, int(math.log(max(most / COUNT, 1), RATIO)) + 1)  # each form occurs RATIO times as often, the first word COUNT times
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = store(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
