"""A training corpus from raw documents, in five stages.

quality -> near duplicates -> benchmark decontamination -> mixing -> sharding.  Each stage takes (spark, docs, sf_dir) and
gives a DataFrame that is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, linecrf, mixing, pathjoin, sharding
from tidemark.llm.queries import QUALITY, SHARDS, quality_field, table
from tidemark.llm.stage import settle

#: Keys that are broadcast at most; beyond it, a join does the same.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores under QUALITY go."""
    field = quality_field(docs, table(spark, sf_dir, "labels"))
    return linecrf.score(docs, field, out="quality_score").filter(F.col("quality_score") >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id (of texts that share it, the smallest hash)."""
    key = F.struct(F.col("doc_id").isNull().alias("__none"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash")).alias("key")
    kept = settle(pathjoin.join(docs.select(key, "text"), "key").filter("kept").select("key.*").groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("__n")))
    keys = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    once = docs.join(keys.filter("__n = 1"), same, "left_semi")
    repeated = kept.filter("__n > 1")
    if repeated.isEmpty():
        return once
    # Rows that are copies in id and text: one of each stays; rows without words are in no class, so all of them do.
    words = F.col("text").rlike(mixing.WORD)
    copies = docs.join(repeated, same, "left_semi")
    return once.unionByName(copies.filter(words).dropDuplicates(["doc_id", "text"])).unionByName(copies.filter(~F.coalesce(words, F.lit(False))))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes once for each epoch that takes words of it, with those words."""
    sizes = settle(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), mixing.words(F.col("text")).alias("size")))
    taken = mixing.texts(docs, mixing.mix(sizes))
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards by the document's id; slots are gapless in each."""
    return sharding.with_slots(sharding.assign(docs, "doc_id", [1.0] * SHARDS), "doc_id", ("n_chars",))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", clean_of_benchmarks), ("mix", mix), ("shard", shard)]

#: SQL can express neither the fitted field nor the mix of what it leaves; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
