"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing and sharding, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as Parquet in the shared
folder and reads it again as the next stage's documents.  All stages but the last return the columns of documents; the
last adds size, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyflow.llm import decontaminate, jaccard, mixing, quality, sharding
from studyflow.llm.shared import dropped, fresh, written

#: Words of a shingle, and least similarity in percent, of near duplicates (op5's query has its own).
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group that links of similar sets of five-word shingles connect."""
    return jaccard.keep_one_each(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate takes it."""
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with size, shard and slot (under other names where documents have such columns)."""
    names = [n.removeprefix("_") if n.removeprefix("_") not in docs.columns else n for n in fresh(docs, "size", "shard", "slot")]
    found = sharding.assign_shards(docs)
    return found.select("record.*", *(F.col(c).alias(n) for c, n in zip(("size", "shard", "slot"), names)))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: SQL cannot express the exact similarity join's components over whole tables in reasonable time; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
