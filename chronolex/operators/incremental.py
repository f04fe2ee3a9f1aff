"""Corpus synchronisation: diffs, overlays, reuse by content and publishing by an immutable snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(stored: DataFrame, incoming: DataFrame, key: str, compared: list[str], embedded: list[str]) -> DataFrame:
    """``key``, state (new, removed, updated, unchanged) and the stale flags of each row of either side.

    ``embedded`` names the compared columns that go into a vector; only their change makes a stored vector stale.
    Derived rows are stale where their source was updated or removed. Nulls equal nulls.
    """
    s = stored.select(F.col(key), F.struct(*compared).alias("s"))
    i = incoming.select(F.col(key), F.struct(*compared).alias("i"))
    changed = lambda names: F.array_contains(F.array(*[~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}")) for c in names]), True)
    state = F.when(F.col("s").isNull(), "new").when(F.col("i").isNull(), "removed").when(changed(compared), "updated").otherwise("unchanged")
    both = s.join(i, key, "full").withColumn("state", state)
    return both.select(
        key, "state", ((F.col("state") == "updated") & changed(embedded)).alias("stale_embedding"), F.col("state").isin("updated", "removed").alias("stale_derived"),
        F.when(F.col("state") == "updated", F.filter(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}")), F.lit(c)) for c in compared]), lambda x: x.isNotNull())).alias("changed"),
    )


def overlay(stored: DataFrame, incoming: DataFrame, deleted: DataFrame, key: str, version: str) -> DataFrame:
    """What the corpus will hold: stored rows whose version is neither deleted nor replaced, and the incoming rows."""
    replaced = incoming.select(version).distinct()
    kept = stored.join(deleted.select(version).distinct(), version, "left_anti").join(replaced, version, "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def pending_embeddings(rows: DataFrame, embeddings: DataFrame, key: str, text_hash: str) -> DataFrame:
    """``key`` and state of each row's vector: missing, stale (another text's) or current."""
    held = embeddings.select(F.col(key), F.col(text_hash).alias("held"))
    joined = rows.select(key, text_hash).join(held, key, "left")
    return joined.select(key, F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col(text_hash), "stale").otherwise("current").alias("state"))


def reuse_by_hash(pending: DataFrame, embeddings: DataFrame, key: str, text_hash: str, vector: str) -> DataFrame:
    """Vectors for pending rows from rows of the same text; of several the one with the smallest key."""
    by_hash = embeddings.groupBy(text_hash).agg(F.min(F.col(key)).alias("from_key"), F.min_by(vector, key).alias(vector))
    return pending.join(by_hash, text_hash)


def earliest_deletions(feed: DataFrame, by: list[str], day: str) -> DataFrame:
    return feed.groupBy(*by).agg(F.min(day).alias(day))


def quarantine(versions: DataFrame, deletions: DataFrame, key: str, day: str) -> DataFrame:
    """Versions in the feed become deleted on the earlier of the days known; replaying the same feed changes nothing."""
    feed = earliest_deletions(deletions, [key], day).withColumnRenamed(day, "_day")
    joined = versions.join(feed, key, "left")
    return joined.withColumn(day, F.least(F.col(day), F.col("_day"))).withColumn("record_state", F.when(F.col("_day").isNotNull(), "deleted").otherwise(F.col("record_state"))).drop("_day")


def last_wins(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def violations(rules: dict[str, DataFrame], samples: int = 10) -> DataFrame:
    """reason, how many ids violate it and the first of them; ``rules`` maps a reason to its table of ids (column id)."""
    parts = [df.select(F.lit(reason).alias("reason"), F.col("id").cast("string").alias("id")) for reason, df in rules.items()]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    ids = everything.distinct()
    w = Window.partitionBy("reason").orderBy("id")
    few = ids.withColumn("n", F.row_number().over(w))
    return few.groupBy("reason").agg(F.count("*").alias("n_ids"), F.array_sort(F.collect_list(F.when(F.col("n") <= samples, F.col("id")))).alias("first_ids"))


def publish(df: DataFrame, root: str, snapshot_id: str) -> str:
    """Write a snapshot that never changes under ``root``; an id that exists already is an error."""
    path = f"{root.rstrip('/')}/snapshot={snapshot_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def point_to(spark, root: str, snapshot_id: str) -> None:
    """Append the pointer that readers follow; the newest row is the active snapshot."""
    row = spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.current_timestamp().alias("activated_at"), F.monotonically_increasing_id().alias("n"))
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")


def active(spark, root: str) -> DataFrame:
    pointer = spark.read.parquet(f"{root.rstrip('/')}/pointer").agg(F.max_by("snapshot_id", "activated_at").alias("s")).first()["s"]
    return spark.read.parquet(f"{root.rstrip('/')}/snapshot={pointer}")
