"""A corpus pipeline in five stages, each over all that the one before kept.

Stages take (spark, docs, sf_dir) and return documents; between stages ``run``
writes Parquet into the shared folder and reads it again.

Decisions are made by row, not by doc_id. Rows without an id, and texts of an id
beyond its first (by a hash of the text), are documents of their own, which come
after all rows with an id of their own. Repeated rows, equal in id and text, are
exact copies.

Odd input: null and empty texts are never toxic beyond the base rate, copies,
repeats or contaminated, so they stay as they are, each row of them; an empty
table gives an empty table; further columns travel with their row, whatever they
are called, but for those of the last stage's results, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontam, minhash, mixing, suffix, toxicity
from fathom.llm.scratch import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, index)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __row: doc_id where it names one text, else a number beyond all ids; rows equal in id and text share it."""
    pairs = store(docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash")).distinct(), "pairs")
    firsts = pairs.where("__id is not null").groupBy("__id").agg(F.min("__hash").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    further = pairs.join(firsts, "__id").where("__hash > __first").select("__id", "__hash").union(pairs.where("__id is null"))
    beyond = (pairs.agg(F.max("__id")).first()[0] or 0) + 1
    numbers = further.orderBy(F.col("__id").asc_nulls_last(), "__hash").withColumn("__new", F.monotonically_increasing_id() + F.lit(beyond))
    numbers = store(numbers, "rows")
    if numbers.isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(numbers, same, "left").select(*docs.columns, F.coalesce("__new", F.col("doc_id").cast("long")).alias("__row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    keyed = _keyed(docs)
    found = store(minhash.near_duplicates(keyed, "__row").select(F.col("doc_id").alias("__row"), "n_shingles", "kept"), "verdicts")
    kept = keyed.join(found.where("not kept").select("__row"), "__row", "left_anti")
    again = found.where("kept and n_shingles > 0").groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row")
    again = store(again, "again")
    if not again.isEmpty():
        kept = kept.join(again, "__row", "left_anti").unionByName(kept.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte runs are cut out, with what they leave of split characters; emptied documents go."""
    named = docs.withColumn("__none", F.col("text").isNull())
    found = suffix.deduplicate(named, carry=True).where("n_removed < n_bytes or n_removed = 0")
    joined = found.select("row.*", F.when(~F.col("row.__none"), F.col("kept")).alias("text"), (F.col("n_removed") > 0).alias("__cut"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    keyed = _keyed(docs)
    named = keyed.select(F.col("__row").alias("doc_id"), "text")
    hit = decontam.decontaminate(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("__row"))
    return keyed.join(hit, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in a mix by the target weights of their sources."""
    return mixing.mix(docs, mixing.target_weights(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
