"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolex.llm import decontaminate, mixing, sharding, shingle_links, toxicity_chain
from chronolex.llm.durable import keep


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    return toxicity_chain.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by fingerprints or by shingles: the one with the smallest doc_id."""
    return shingle_links.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, in shuffled order inside each shard."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and learned scores have no form in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
