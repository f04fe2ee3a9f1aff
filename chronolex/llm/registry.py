"""The queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import ann_additive, chat_format, decontaminate, mixing, ngram_join, quality_fm, secret_scan, sharding, simhash_dedup, spelling, token_align, token_count, toxicity_chain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out anew only if their files make fewer partitions than there are cores.

    The number of partitions is read without any column. Large tables have more partitions and stay as they are.
    """
    docs, cores = _table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    partitions = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return docs.repartition(cores) if partitions < cores else docs


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat_format.digest(chat_format.formatted(turns.unionByName(more)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(_documents(spark, sf_dir)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_table(spark, sf_dir, "documents"), payload=False)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_additive.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.digest(_documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_fm, op2_toxicity_chain, op3_chat_format, op4_secrets, op5_decontaminate, op6_mixing, op7_sharding, op8_additive_ann, op9_token_counts, op10_simhash, op11_token_alignment, op12_spelling_variants, op13_ngram_join)}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), cut AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '</', '<\/'), '##', '#\#') AS safe,
        replace(replace(replace(role, '\', '\\'), '</', '<\/'), '##', '#\#') AS safe_role,
        before IS NULL OR before <> role AS opens
    FROM marked
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(safe) + CASE WHEN opens THEN 19 + length(safe_role) ELSE 7 END) AS BIGINT) AS formatted_chars
FROM cut GROUP BY conv_id""",
}
