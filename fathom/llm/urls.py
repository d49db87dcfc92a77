"""URL verdicts from prefix rules and, where no rule fits, a character language-model ratio.

Two variable-order Markov models over characters are counted, one from the
addresses that rules allow and one from those that rules block. The estimate of
order n backs off by interpolation: p_n = (count + MASS * p_{n-1}) / (context
count + MASS), so an unseen context falls back to the next shorter one. An
address scores the mean over its characters of ln p_allow - ln p_block. The
cut-off is calibrated on rule-decided addresses that the counts leave out, as
the threshold that best separates them. Only DataFrame functions are used.

Each distinct (host, path) is scored once, so a hot address costs no more than
any other. An address is cut into characters once and travels as a 128-bit key
with its distinct grams and their counts, so the work is linear in its length.
Scores of character grams are rounded to whole micro-nats, which makes sums
independent of the order of addition. The cut-off is found from the distinct
scores in milli-nats, which are bounded by the model's least probability (about
100,000 of either sign).

Results for odd input: a null url, or one without ``://``, has empty host and
path, fits no rule and is judged by the model as an empty address; repeated
rows and null ids are judged row by row; without addresses on either side of
the rules the models are uniform, scores are 0 and the cut-off is 0, so the
verdict is allow; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

#: (action, host suffix, path prefix). Fixed values.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ORDER = 5
MASS = 4.0
SYMBOLS = 128.0
FOLD = 5
BEGIN, END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)))
    return pick([h + p for _, h, p in ordered]), pick([a for a, _, _ in ordered])


def _grams(addresses: DataFrame, *kept: str) -> DataFrame:
    """(key, kept columns, gram, times): the runs of ORDER characters that end at each character of an address, and how often."""
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), "host", "path", F.lit(END))
    cut = addresses.select("key", *kept, F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0)).alias("chars"))
    places = F.sequence(F.lit(0), F.size("chars") - ORDER)
    grams = F.transform(places, lambda i: F.concat(*(F.get("chars", i + k) for k in range(ORDER))))
    return cut.select("key", *kept, F.explode(grams).alias("gram")).groupBy("key", *kept, "gram").agg(F.count("*").alias("times"))


def gram_scores(grams: DataFrame, counted: DataFrame) -> DataFrame:
    """(gram, score): the difference of log probabilities in micro-nats of every gram in grams.

    counted has the distinct grams of the rule-decided addresses with counts n_allow and n_block.
    """
    out = grams.select("gram").distinct()
    allow = block = F.lit(1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        counts = counted.groupBy(F.right("gram", F.lit(n)).alias(f"g{n}")).agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b"))
        context = counts.groupBy(F.left(f"g{n}", F.lit(n - 1)).alias(f"c{n}")).agg(F.sum("a").alias(f"ca{n}"), F.sum("b").alias(f"cb{n}"))
        out = out.withColumn(f"g{n}", F.right("gram", F.lit(n))).withColumn(f"c{n}", F.left(f"g{n}", F.lit(n - 1)))
        out = out.join(counts.withColumnsRenamed({"a": f"a{n}", "b": f"b{n}"}), f"g{n}", "left").join(context, f"c{n}", "left")
        got = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        allow = (got(f"a{n}") + F.lit(MASS) * allow) / (got(f"ca{n}") + F.lit(MASS))
        block = (got(f"b{n}") + F.lit(MASS) * block) / (got(f"cb{n}") + F.lit(MASS))
    return out.select("gram", F.round((F.log(allow) - F.log(block)) * 1e6).cast("long").alias("score"))


def cut_off(scored: DataFrame) -> int:
    """The milli-nat threshold with the best sum of true-allow and true-block rates over held-out addresses."""
    by = scored.groupBy("milli").agg(F.sum(F.when(F.col("action") == "allow", F.col("n"))).alias("a"), F.sum(F.when(F.col("action") == "block", F.col("n"))).alias("b"))
    rows = sorted((r.milli, r.a or 0, r.b or 0) for r in by.collect())
    all_a, all_b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not all_a or not all_b:
        return 0
    best, under_a, under_b = (-1.0, 0), 0, 0
    for k, (milli, a, b) in enumerate(rows):
        low = rows[k - 1][0] if k else milli
        best = max(best, ((all_a - under_a) / all_a + under_b / all_b, (low + milli) // 2 + (low < milli)))
        under_a, under_b = under_a + a, under_b + b
    return best[1]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (milli-nats a character) of every row."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumn("key", F.unhex(F.md5(F.concat(F.col("host"), F.lit("\u0001"), F.col("path")).cast("binary"))))
    addresses = named.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n")).withColumn("rule", rule).withColumn("action", action)
    addresses = addresses.withColumn("held", F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int") % FOLD == 0)
    addresses = store(addresses, "addresses")
    seen = lambda a: F.sum(F.when(F.col("action") == a, F.col("n") * F.col("times")).otherwise(0))
    known = _grams(addresses.where("action is not null and not held"), "action", "n").groupBy("gram").agg(seen("allow").alias("n_allow"), seen("block").alias("n_block"))
    grams = store(_grams(addresses), "url-grams")
    scores = store(gram_scores(grams, store(known, "grams")), "gram-scores")
    total = grams.join(scores, "gram").groupBy("key").agg(F.sum(F.col("score") * F.col("times")).alias("total"), F.sum("times").alias("chars"))
    milli = F.round(F.col("total") / F.col("chars") / 1000.0).cast("long")
    scored = store(addresses.join(total, "key").select("key", "n", "rule", "action", "held", milli.alias("milli")), "url-scores")
    cut = cut_off(scored.where("held and action is not null"))
    verdict = F.coalesce("action", F.when(F.col("milli") >= cut, "allow").otherwise("block"))
    return named.join(scored.select("key", "rule", verdict.alias("verdict"), F.col("milli").alias("score")), "key").select("page_id", "host", "path", "rule", "verdict", "score")
