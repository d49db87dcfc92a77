"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

One pass over the texts counts each document's statistics. From labelled rows the
learner covers the poor ones rule by rule: on the growing part a rule takes the
threshold condition of largest information gain until it covers no good row; on
the pruning part its last conditions fall away while that makes it no worse; a
rule that isn't nearly always right there ends the list. Thresholds lie midway
between the values of two rows. ``verdict`` renders the list as one ordered
CASE expression over the statistics, evaluated without Python.

Statistics cover whole texts; the fitting sample is bounded by SAMPLE rows of each
label, those of the smallest hash of the id. Lines end at a line feed, words are
what lies between ASCII blanks, and words or lines are equal where their bytes are.

Results for odd input: a null or empty text has no words and fails the base rule;
repeated rows are each judged; of several labels of an id the least counts; rows
without id are judged but not learned from; without labelled rows of both kinds
the list is empty and the base rule alone decides; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import store

#: Words of a repeated window, and the fixed values of the base rule.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Labelled rows of each label to learn from, at most; candidate thresholds of a feature; conditions of a rule; rules of a list.
SAMPLE, CUTS, CONDITIONS, RULES = 4000, 64, 4, 16
#: A rule stands if so large a share of the pruning rows it covers is poor, and it covers so many of them.
PRECISION, COVER = 0.97, 2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stutter", "n_single", "n_upper", "n_digits", "n_punct", "longest_word")
#: What rules may test: a statistic, or a statistic for each of another.
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "longest_word": ("longest_word", None), "symbols": ("n_symbols", "word_chars"), "punctuation": ("n_punct", "word_chars"),
    "capitals": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "variety": ("n_distinct", "n_words"), "stutter": ("n_stutter", "n_words"), "single": ("n_single", "n_words"),
}


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _repeated(code: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it; code numbers the words by content."""
    if len(code) < WINDOW:
        return np.zeros(docs, np.int64)
    start = np.arange(len(code) - WINDOW + 1)
    start = start[owner[start] == owner[start + WINDOW - 1]]
    run = owner[start]
    for k in range(WINDOW):  # numbers of ever longer runs, so a window's number tells its document and all its words
        run = _dense(run * (int(code.max()) + 1) + code[start + k])
    hit = np.zeros(len(code) + 1, np.int64)
    often = start[(np.bincount(run) > 1)[run]] if len(run) else start
    np.add.at(hit, often, 1)
    np.add.at(hit, often + WINDOW, -1)
    return np.bincount(owner, np.cumsum(hit)[:-1] > 0, docs).astype(np.int64)


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row per document of the statistics COUNTS."""
    docs = len(bounds) - 1
    starts, ends, before = blocks.words(data, bounds, blocks.BLANK_WORDS)
    owner = np.repeat(np.arange(docs), np.diff(before))
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[ends] - points[starts]
    per_doc = lambda weight: np.bincount(owner, weight, docs).astype(np.int64)
    first, code = blocks.distinct_spans(data, starts, ends)
    code = code.astype(np.int64)
    distinct = np.bincount(np.unique(owner * max(len(first), 1) + code) // max(len(first), 1), minlength=docs)
    stutter = np.zeros(len(code), bool)
    stutter[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, owner, long)

    feeds = np.flatnonzero(data == 10)
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    line_start = np.union1d(feeds + 1, filled)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 10) if len(line_start) else line_end[:0]
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_owner = np.searchsorted(bounds, line_start, "right") - 1
    kinds, line = blocks.distinct_spans(data, line_start, line_end)
    lines = np.bincount(line_owner, minlength=docs)
    unlike = np.bincount(np.unique(line_owner * max(len(kinds), 1) + line) // max(len(kinds), 1), minlength=docs)
    columns = (np.diff(before), per_doc(long), sums(_SYMBOLS[data]), lines - unlike, _repeated(code, owner, docs), lines, distinct, per_doc(stutter), per_doc(long == 1), sums(_UPPER[data]), sums(_DIGIT[data]), sums(_PUNCT[data]), longest)
    return np.stack([c.astype(np.int64) for c in columns], axis=1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, data, bounds in blocks.chunks(batch.column(1)):
                table = counts(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(table[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(_counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.cut if self.above else values[self.feature] <= self.cut

    def column(self) -> Column:
        part, whole = FEATURES[self.feature]
        value = F.col(part).cast("double") if whole is None else F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def features(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The values that rules test, as their Spark expressions give them."""
    value = lambda part, whole: table[part].astype(float) if whole is None else table[part].astype(float) / np.maximum(table[whole], 1)
    return {name: value(*of) for name, of in FEATURES.items()}


def _covered(rule: Rule, values: dict[str, np.ndarray], size: int) -> np.ndarray:
    held = np.ones(size, bool)
    for condition in rule:
        held &= condition.holds(values)
    return held


def _grow(values: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """Conditions of largest gain, until no good row is covered."""
    rule: Rule = ()
    held = np.ones(len(poor), bool)
    while len(rule) < CONDITIONS and (held & ~poor).any() and (held & poor).any():
        p0, n0 = int((held & poor).sum()), int((held & ~poor).sum())
        found: tuple[float, Condition] | None = None
        for name, column in values.items():
            distinct = np.unique(column[held])
            if len(distinct) < 2:
                continue
            middle = (distinct[1:] + distinct[:-1]) / 2
            cuts = middle if len(middle) <= CUTS else middle[np.linspace(0, len(middle) - 1, CUTS).astype(int)]
            low_p = np.searchsorted(np.sort(column[held & poor]), cuts, "right")
            low_n = np.searchsorted(np.sort(column[held & ~poor]), cuts, "right")
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = np.where(p > 0, p * (np.log2((p + 1e-12) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -np.inf)
                k = int(gain.argmax())
                if gain[k] > 0 and (found is None or gain[k] > found[0]):
                    found = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if found is None:
            break
        rule += (found[1],)
        held &= found[1].holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """The shortest start of the rule that tells poor from good rows best."""

    def worth(k: int) -> float:
        held = _covered(rule[:k], values, len(poor))
        p, n = int((held & poor).sum()), int((held & ~poor).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def cover(values: dict[str, np.ndarray], poor: np.ndarray, pruning: np.ndarray) -> list[Rule]:
    """Rules for poor rows, in order; rows where pruning is set only judge them."""
    out: list[Rule] = []
    left = np.ones(len(poor), bool)
    part = lambda which: {k: v[which] for k, v in values.items()}
    while len(out) < RULES:
        growing, judging = left & ~pruning, left & pruning
        rule = _grow(part(growing), poor[growing])
        if not rule:
            break
        rule = _prune(rule, part(judging), poor[judging])
        held = _covered(rule, part(judging), int(judging.sum()))
        right = int((held & poor[judging]).sum())
        if right < COVER or right < PRECISION * int(held.sum()):
            break
        out.append(rule)
        left &= ~_covered(rule, values, len(poor))
    return out


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for statistics of documents, from labels (doc_id, quality): 0 is poor. At most SAMPLE rows of each label reach the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    joined = stats.join(known, "doc_id").withColumn("place", F.xxhash64("doc_id"))
    rows = [r for q in (0, 1) for r in joined.where(F.col("quality") == q).orderBy("place", *COUNTS).limit(SAMPLE).collect()]
    if len({r.quality for r in rows}) < 2:
        return []
    table = {c: np.array([r[c] for r in rows], np.int64) for c in COUNTS}
    poor, place = np.array([r.quality == 0 for r in rows]), np.array([r.place for r in rows], np.int64)
    return cover(features(table), poor, place % 3 == 0)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _all(rule: Rule) -> Column:
    held = rule[0].column()
    for condition in rule[1:]:
        held = held & condition.column()
    return held


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), null where none does: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(k)).otherwise(out)
    return out


def texts(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, rule)) for rule in rules]


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, kept, and rule (the conditions that reject it, else null) of every row."""
    stats = store(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("number", verdict(rules))
    named = F.element_at(F.array(*(F.lit(t) for t in texts(rules))), F.col("number")) if rules else F.lit(None).cast("string")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("number").isNull()).withColumn("rule", F.when(F.col("number").isNotNull(), named)).drop("number")
