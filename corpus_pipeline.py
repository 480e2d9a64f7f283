"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.  Each stage's result is written as Parquet
and read again as the next one's docs.

Nulls and empty texts go through every stage as their operator defines: an
empty text is scored like any other, all empty texts are near-duplicates of
each other, have no words to be contaminated or to count in the mix, and so
end at the mix, which takes documents by their words.  Repeated rows end as
one; empty tables stay empty; further columns of documents go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, sharding, simhash, toxicity
from tessera.llm.common import P, read, written

N_SHARDS = 24


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under one half, learned from the labelled part of this stage's documents."""
    score = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic")
    kept = score(docs.withColumn(P + "all", F.struct(*docs.columns)))
    return kept.filter(F.col("score") < 0.5).select(P + "all.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the least id."""
    return simhash.representatives(docs, k=3, radius=3)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's passages."""
    row = P + "row"
    found = decontam.contamination(docs.select(F.struct(*docs.columns).alias(row), "text"), read(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(f"{row}.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    row = P + "row"
    d = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", "text")
    taken = mixing.mixed_rows(mixing.mix(d, mixing.word_count(), mixing.symbol_weight()))
    return taken.select(f"{row}.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard_rows(docs, n_shards=N_SHARDS)


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shards),
]

#: The trained model and the linked components have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
