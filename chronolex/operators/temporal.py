"""Validity intervals: half-open [from, to), null ends open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_on(day: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    return F.coalesce(F.col(start) <= day, F.lit(True)) & F.coalesce(F.col(end) > day, F.lit(True))


def searchable(parser: str = "3") -> Column:
    """Available, of the current parser, and in force, scheduled or abolished with a known end."""
    state = F.col("lifecycle_state")
    return (F.col("record_state") == "available") & (state.isin("active", "scheduled") | ((state == "abolished") & F.col("effective_to").isNotNull())) & (F.col("parser_version") == parser)


def effective_periods(versions: DataFrame, document: str = "document_id", start: str = "effective_from") -> DataFrame:
    """``versions`` with effective_to: the document's next distinct start, shared by versions of the same day."""
    later = Window.partitionBy(document).orderBy(F.datediff(F.col(start), F.lit("1970-01-01").cast("date"))).rangeBetween(1, Window.unboundedFollowing)
    return versions.withColumn("effective_to", F.min(start).over(later))


def conflicting_starts(versions: DataFrame, document: str = "document_id", start: str = "effective_from") -> DataFrame:
    """Documents and days with more than one version, which a store refuses."""
    return versions.groupBy(document, start).agg(F.count("*").alias("n_versions")).where("n_versions > 1")


def overlaps(versions: DataFrame, key: str = "version_id", document: str = "document_id") -> DataFrame:
    """Pairs of a document's versions whose periods overlap: an equi-join on the document, intervals as its residual."""
    a, b = versions.alias("a"), versions.alias("b")
    open_end = F.lit("9999-12-31").cast("date")
    meets = (F.col("a.effective_from") < F.coalesce("b.effective_to", open_end)) & (F.col("b.effective_from") < F.coalesce("a.effective_to", open_end))
    return a.join(b, (F.col(f"a.{document}") == F.col(f"b.{document}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & meets).select(
        F.col(f"a.{document}").alias(document), F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id")
    )


def close_versions(versions: DataFrame, starts: DataFrame, document: str = "document_id") -> DataFrame:
    """Earlier versions that overlap a new start end there; a derived table instead of an update in place."""
    new = starts.groupBy(document).agg(F.min("effective_from").alias("new_start"))
    closes = (F.col("effective_from") < F.col("new_start")) & F.coalesce(F.col("effective_to") > F.col("new_start"), F.lit(True))
    return versions.join(new, document, "left").withColumn("effective_to", F.when(F.coalesce(closes, F.lit(False)), F.col("new_start")).otherwise(F.col("effective_to"))).drop("new_start")


def first_per_article(hits: DataFrame, by: list[str], order: list[Column], whole_path_root: str = "body") -> DataFrame:
    """The first hit of each article in rank order; under the root ``body`` a whole path is an article of its own."""
    root = F.substring_index("path", "/", 1)
    article = F.when(root == whole_path_root, F.col("path")).otherwise(root)
    w = Window.partitionBy(*by, "document_id", article).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
