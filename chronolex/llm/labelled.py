"""Bounded, reproducible samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.durable import free_name


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int, name: str) -> DataFrame:
    """The rows of ``docs`` that ``labels`` (doc_id, label) has, for at most ``most`` label rows, with the label as ``name``.

    The rows with the smallest seeded hashes of their ids are taken; rows without an id or label aren't. As ``most``
    bounds them, they are broadcast; of repeated documents each one stays. ``name`` must be no column of ``docs``.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(name))
    own = free_name(docs, "id")
    some = some.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", own)
    return docs.join(F.broadcast(some), F.col("doc_id") == F.col(own)).drop(own)
