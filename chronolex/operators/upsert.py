"""Insert or update document versions with all that hangs on their provisions, as one new snapshot.

Every table of the corpus follows from one table of changed provisions, which is written once: vectors whose text changed,
edges that touch a changed or removed provision, and obligations read off one go; provisions and versions are replaced.
A preview counts the same changes and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import incremental
from chronolex.sources import publishing
from chronolex.sources.shared import new_folder

#: The tables of a corpus and the columns that they have besides what the caller adds.
TABLES = {
    "versions": ("document_id", "version_id", "effective_from", "effective_to"), "provisions": ("version_id", "path"), "vectors": ("version_id", "path"),
    "edges": ("version_id", "path", "to_version_id", "to_path"), "obligations": ("version_id", "path"),
}
KEY = ["version_id", "path"]


def changes(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], compared: Sequence[str], embedded: Sequence[str]) -> DataFrame:
    """(version_id, path, state, stale_embedding, stale_derived) of the provisions of incoming versions, written once.

    Stored provisions of versions that don't come in aren't looked at. States are new, removed, updated and unchanged; columns
    in ``embedded`` make vectors stale, any in ``compared`` makes edges and obligations stale. Nulls equal nulls.
    """
    coming = incoming["versions"].select("version_id").distinct()
    key = F.struct(*KEY).alias("key")
    before = stored["provisions"].join(coming, "version_id", "left_semi").select(key, *KEY, *compared)
    after = incoming["provisions"].select(key, *KEY, *compared)
    found = incremental.diff(before, after, "key", [*KEY, *compared], list(embedded))
    rows = found.select("key.*", "state", "stale_embedding", "stale_derived")
    path = new_folder(rows.sparkSession, "changes")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def closed_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` and ``incoming`` versions together; each ends where the document's next version begins, or earlier if it did.

    Of a version that is in both the incoming one counts. Of versions that begin on one day none ends the other.
    """
    kept = stored.join(incoming.select("version_id").distinct(), "version_id", "left_anti")
    both = kept.unionByName(incoming.select(*stored.columns))
    later = Window.partitionBy("document_id").orderBy(F.col("effective_from").cast("timestamp").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    following = F.min("effective_from").over(later)
    return both.withColumn("effective_to", F.least("effective_to", following))


def upserted(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """All tables of the corpus after ``incoming`` (versions, provisions), by the ``changed`` provisions."""
    gone = changed.where("state in ('updated', 'removed')").select(*KEY)
    stale = changed.where("stale_embedding or state = 'removed'").select(*KEY)
    derived = changed.where("stale_derived").select(*KEY)
    coming = changed.where("state in ('new', 'updated')").select(*KEY)
    provisions = stored["provisions"].join(gone, KEY, "left_anti").unionByName(incoming["provisions"].join(coming, KEY, "left_semi").select(*stored["provisions"].columns))
    far = derived.select(F.col("version_id").alias("to_version_id"), F.col("path").alias("to_path"))
    edges = stored["edges"].join(derived, KEY, "left_anti").join(far, ["to_version_id", "to_path"], "left_anti").select(*stored["edges"].columns)
    return {
        "versions": closed_versions(stored["versions"], incoming["versions"]).select(*stored["versions"].columns), "provisions": provisions.select(*stored["provisions"].columns),
        "vectors": stored["vectors"].join(stale, KEY, "left_anti").select(*stored["vectors"].columns), "edges": edges, "obligations": stored["obligations"].join(derived, KEY, "left_anti").select(*stored["obligations"].columns),
    }


def preview(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], changed: DataFrame) -> DataFrame:
    """(counter, n) of what an upsert would do: provisions by state, versions, what goes stale, and versions it would close."""
    spark = changed.sparkSession
    before = stored["versions"]
    ids = incoming["versions"].select("version_id").distinct().withColumn("there", F.lit(True))
    versions = before.select("version_id").withColumn("known", F.lit(True)).join(ids, "version_id", "right")
    after = closed_versions(before, incoming["versions"])
    was_open = before.where("effective_to is null").join(ids, "version_id", "left_anti").select("version_id")
    counts = [changed.groupBy(F.concat(F.lit("provisions_"), "state").alias("counter")).agg(F.count("*").alias("n"))]
    counts.append(versions.groupBy(F.when(F.col("known"), "versions_updated").otherwise("versions_new").alias("counter")).agg(F.count("*").alias("n")))
    counts.append(after.where("effective_to is not null").join(was_open, "version_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("would_close_versions").alias("counter"), "n"))
    new = upserted(stored, incoming, changed)
    for table in ("vectors", "edges", "obligations"):
        both = stored[table].agg(F.count("*").alias("b")).crossJoin(new[table].agg(F.count("*").alias("a")))  # one row each
        counts.append(both.select(F.lit(f"{table}_invalidated").alias("counter"), (F.col("b") - F.col("a")).alias("n")))
    names = ["provisions_new", "provisions_updated", "provisions_removed", "provisions_unchanged", "versions_new", "versions_updated", "would_close_versions", "vectors_invalidated", "edges_invalidated", "obligations_invalidated"]
    every = spark.createDataFrame([(n,) for n in names], "counter string")
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return every.join(out, "counter", "left").select("counter", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def rules(incoming: dict[str, DataFrame]) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """What the staged tables have to meet before they become active: each gives the keys that break it."""
    orphans = lambda name: lambda t: t[name].select(*KEY).join(t["provisions"].select(*KEY), KEY, "left_anti")

    def overlapping(t: dict[str, DataFrame]) -> DataFrame:
        w = Window.partitionBy("document_id").orderBy("effective_from", "version_id")
        following = t["versions"].withColumn("next", F.lead("effective_from").over(w))
        return following.where("next > effective_from and (effective_to is null or effective_to > next)").select("version_id")

    def not_taken(t: dict[str, DataFrame]) -> DataFrame:
        mine = t["provisions"].join(incoming["versions"].select("version_id").distinct(), "version_id", "left_semi").select(*KEY)
        return mine.withColumn("side", F.lit(1)).unionByName(incoming["provisions"].select(*KEY).withColumn("side", F.lit(-1))).groupBy(*KEY).agg(F.sum("side").alias("s")).where("s <> 0")

    return {
        "a provision twice": lambda t: t["provisions"].groupBy(*KEY).count().where("count > 1"), "a provision without a version": lambda t: t["provisions"].select("version_id").distinct().join(t["versions"], "version_id", "left_anti"),
        **{f"{name} without a provision": orphans(name) for name in ("vectors", "edges", "obligations")}, "overlapping versions": overlapping, "an incoming provision not taken": not_taken,
    }


def upsert(root: str, snapshot: str, incoming: dict[str, DataFrame], compared: Sequence[str], embedded: Sequence[str], patience: float = publishing.PATIENCE, at: Callable[[str], None] = lambda step: None) -> dict:
    """Publish the corpus under ``root`` with ``incoming`` in it as ``snapshot``: behind the gate, checked, all or nothing."""
    spark = incoming["versions"].sparkSession
    stored = publishing.active_tables(spark, root)
    changed = changes(stored, incoming, compared, embedded)
    return publishing.publish_tables(upserted(stored, incoming, changed), root, snapshot, rules(incoming), patience, at)
