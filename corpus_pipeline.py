"""The corpus pipeline: language ID, near duplicates, decontamination, mixing and sharding.

Every stage works on all rows that the stage before kept; between stages the
rows are a Parquet table in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafline.llm import decontaminate, jaccard, langid, mixing, sharding
from leafline.llm.storage import discard, stored

#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Mixing: every document is drawn once at least, none more than twice.
TARGET_ENTROPY, MAX_REPETITION = 0.995, 1.5
N_SHARDS = 8


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_first(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document under the mixture's weights."""
    drawn = mixing.mix_sources(docs, target_entropy=TARGET_ENTROPY, max_repetition=MAX_REPETITION)
    return drawn.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every drawn row, with its other columns but the text."""
    return sharding.shard_documents(docs, N_SHARDS, carry=("lang", "source", "n_chars")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix),
    ("sharding", shard),
]

#: Trained language models and label propagation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # no later stage reads it
            discard(before)
        before = docs
    return docs
