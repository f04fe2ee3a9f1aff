"""Retrieval quality: graded metrics by case, macro averages and deterministic bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.hashing import draw


def case_metrics(rankings: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """By case: precision, direct precision, recall, hit rate and nDCG at k, and the reciprocal rank within ten.

    ``rankings`` has case_id, item_id and rank from 1; ``qrels`` case_id, item_id and grade (1: related, 2: direct).
    Precisions divide by k even where fewer were returned; a case without a direct qrel has a null recall.
    """
    totals = qrels.groupBy("case_id").agg(F.count_if(F.col("grade") == 2).alias("direct"), F.count_if(F.col("grade") == 1).alias("related"))
    return judged_metrics(rankings.join(qrels, ["case_id", "item_id"], "left"), totals, k)


def judged_metrics(judged: DataFrame, totals: DataFrame, k: int = 5, **more: Column) -> DataFrame:
    """``case_metrics`` from ranked items with their grades (case_id, rank, grade: null if the item has no qrel) and from
    ``totals`` (case_id, direct, related): how many qrels each case has, so that they needn't be rows. ``more`` adds
    aggregates of a case's ranked items."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    judged = judged.withColumn("g", F.coalesce("grade", F.lit(0)))
    near = F.col("rank") <= k
    found = judged.groupBy("case_id").agg(
        (F.count_if(near & (F.col("g") > 0)) / k).alias("precision"),
        (F.count_if(near & (F.col("g") == 2)) / k).alias("direct_precision"),
        F.count_if(near & (F.col("g") == 2)).alias("direct_found"),
        F.coalesce(F.sum(F.when(near, gain(F.col("g"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.coalesce(1.0 / F.min(F.when((F.col("g") == 2) & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        *[c.alias(name) for name, c in more.items()],
    )
    best = lambda r: F.when(r <= F.col("direct"), 2).when(r <= F.col("direct") + F.col("related"), 1).otherwise(0)
    ideal = totals.withColumn("idcg", F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, r: s + gain(best(r), r)))
    joined = ideal.join(found, "case_id", "left")
    return joined.select(
        "case_id", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("direct_precision", F.lit(0.0)).alias("direct_precision"),
        F.when(F.col("direct") > 0, F.coalesce("direct_found", F.lit(0)) / F.col("direct")).alias("recall"),
        (F.coalesce("direct_found", F.lit(0)) > 0).cast("double").alias("hit_rate"),
        F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 9).alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), *more,
    )


def facet_recall(rankings: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """By case: the share of facets (column ``facet`` of qrels) that some item in the first k supports, and if all are."""
    return judged_facets(rankings.join(qrels, ["case_id", "item_id"]), qrels.select("case_id", "facet").distinct(), k)


def judged_facets(judged: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """``facet_recall`` from ranked items with qrels (case_id, rank, facet) and the facets of each case (case_id, facet)."""
    wanted = wanted.groupBy("case_id").agg(F.count_distinct("facet").alias("n_facets"))
    seen = judged.where(F.col("rank") <= k).groupBy("case_id").agg(F.count_distinct("facet").alias("n_seen"))
    both = wanted.join(seen, "case_id", "left")
    return both.select("case_id", (F.coalesce("n_seen", F.lit(0)) / F.col("n_facets")).alias("facet_recall"), (F.coalesce("n_seen", F.lit(0)) == F.col("n_facets")).alias("all_facets"))


def family_macro(cases: DataFrame, family: str, metrics: list[str], digits: int = 9) -> DataFrame:
    """Means over families of the means over their cases."""
    means = cases.groupBy(family).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.agg(F.count("*").alias("n_families"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def bootstrap(families: DataFrame, family: str, metric: str, seed: str, repetitions: int = 2000, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over families, resampled with draws that come from hashes alone.

    ``families`` is a bounded evaluation table (one row by family). Repetition r draws position i as the first bytes of
    SHA-256 over "seed:r:i", so every engine that can hash finds the same interval.
    """
    n = families.select(F.row_number().over(Window.orderBy(family)).cast("long").alias("i"), F.col(metric).alias("v")).withColumn("i", F.col("i") - 1)
    size = families.agg(F.count("*").alias("n"))
    spark = families.sparkSession
    grid = spark.range(repetitions).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size)).select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    drawn = grid.withColumn("i", draw(F.concat_ws(":", F.lit(seed), "rep", "slot"), F.col("n"))).join(F.broadcast(n), "i")
    means = drawn.groupBy("rep").agg(F.avg("v").alias("m"))
    edge = (1 - level) / 2
    return means.agg(F.round(F.percentile("m", F.lit(edge)), 9).alias("low"), F.round(F.percentile("m", F.lit(1 - edge)), 9).alias("high"), F.count("*").alias("repetitions"))


def latency_summary(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """min, lower median, p95 by the rounded index rule, max and the number under a second."""
    v = F.array_sort(F.collect_list(ms))
    n = F.size("v")
    at = lambda q: F.element_at("v", F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(q), 0).cast("int"))))
    return rows.groupBy(*by).agg(v.alias("v"), F.count_if(F.col(ms) < 1000).alias("under_1s")).select(
        *by, n.cast("long").alias("n"), F.element_at("v", 1).alias("min"), F.element_at("v", ((n + 1) / 2).cast("int")).alias("p50"), at(0.95).alias("p95"), F.element_at("v", -1).alias("max"), "under_1s"
    )
