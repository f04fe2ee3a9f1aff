"""Connected components of an edge table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.durable import keep, keep_in, new_path

#: A key is hot if it holds more than one in SPREAD of a table's rows; so there are fewer than SPREAD hot keys.
SPREAD = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row of each ``key``.

    The fewer than SPREAD hot keys of ``left`` are found by a count and their rows of ``right`` broadcast; only what is
    left is shuffled by key. ``rows`` is the number of rows of ``left``, counted where it isn't given.
    """
    rows = left.count() if rows is None else rows
    hot = left.groupBy(key).count().where(F.col("count") * SPREAD > max(rows, SPREAD)).select(key)
    hot = F.broadcast(keep(hot, "hot"))
    return left.join(F.broadcast(right.join(hot, key, "left_semi")), key).unionByName(left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key))


def connected(edges: DataFrame, most_passes: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node it reaches.

    Every pass is two grouped minima and two joins on the edge table, which is written to the shared folder each
    time, over the one before the last. Self edges and repeated edges are allowed; an empty table gives an empty result.
    Nodes without an edge to another node aren't returned. The number of passes grows by the square of the logarithm of
    the number of nodes (a chain of 200 takes 9), so ``most_passes`` only stops what would be a fault.
    """
    paths = [new_path(edges.sparkSession, "edges") for _ in range(2)]
    now = keep_in(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), paths[0])
    mark = None
    for k in range(most_passes):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        now = keep_in(small.select("e.a", "e.b").where("a <> b").distinct(), paths[(k + 1) % 2])
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = said
    raise RuntimeError(f"components did not settle in {most_passes} passes")
