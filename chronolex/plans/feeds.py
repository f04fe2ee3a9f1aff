"""Paged feeds: pages written from the tables in both formats, read back page by page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.plans.base import query
from chronolex.sources import paged_feed as P
from chronolex.sources.shared import new_folder

_KINDS = {1: "error", 2: "signup"}


def _pages(t) -> str:
    """A folder of pages: errors as deletions of kind 1 in JSON, signups as those of kind 2 in XML, a hundred to a page."""
    folder = new_folder(t.spark, "feed")
    for kind, event in _KINDS.items():
        rows = t.events.where(F.col("event_type") == event)
        # the number of a row from the counts of blocks of ids before it, so that no task has to sort them all
        block = F.floor(F.col("event_id") / 10_000)
        before = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
        before = before.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        place = F.row_number().over(Window.partitionBy("block").orderBy("event_id")) - 1 + F.col("before")
        numbered = rows.withColumn("block", block).join(before, "block").withColumn("at", place).withColumn("page", (F.floor(F.col("at") / P.SIZE) + 1).cast("int"))
        record = F.struct(F.col("at"), F.struct(F.col("user_id").cast("string").alias(P.NUMBER), F.lit(P.NAMES[kind]).alias(P.NAME), F.date_format("ts", "yyyy.MM.dd" if kind == 1 else "yyyyMMdd").alias(P.DAY)).alias("r"))
        total = rows.agg(F.count("*").alias("total"))
        pages = numbered.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("law")).crossJoin(total)  # one row
        service = F.struct(F.lit("delHst").alias(P.TARGET), F.col("total").alias(P.TOTAL), F.col("page").alias(P.PAGE), "law")
        body = F.to_json(F.struct(service.alias("DataService"))) if kind == 1 else F.to_xml(service, {"rowTag": "DataService"})
        one_line = F.regexp_replace(body, r"\n\s*", "")
        pages.select(F.lit(kind).alias("kind"), "page", one_line.alias("value")).write.mode("append").partitionBy("kind", "page").text(folder)
    return folder


_WHEN = "CASE event_type WHEN 'error' THEN 1 ELSE 2 END AS kind, CAST(user_id AS VARCHAR) AS mst, CAST(ts AS DATE) AS deleted_on FROM events WHERE event_type IN ('error', 'signup')"


@query("page_union_deletions", f"SELECT DISTINCT {_WHEN}")
def page_union_deletions(t):
    return P.deletions(P.read_feed(t.spark, _pages(t))).select("kind", "mst", "deleted_on")


@query("read_deletions_json", "SELECT CAST(user_id AS VARCHAR) AS mst, CAST(ts AS DATE) AS deleted_on, '법령' AS kind_name, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 + 1 AS INTEGER) AS page FROM events WHERE event_type = 'error'")
def read_deletions_json(t):
    return P.read_feed(t.spark, _pages(t), (1,)).select("mst", "deleted_on", "kind_name", "page")


@query("read_deletions_xml", "SELECT CAST(user_id AS VARCHAR) AS mst, CAST(ts AS DATE) AS deleted_on, '행정규칙' AS kind_name, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 + 1 AS INTEGER) AS page FROM events WHERE event_type = 'signup'")
def read_deletions_xml(t):
    return P.read_feed(t.spark, _pages(t), (2,)).select("mst", "deleted_on", "kind_name", "page")
