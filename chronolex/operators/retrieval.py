"""Ranking: exact vector top-k, weighted keyword scores, the staged cascade, rank fusion and rule-based reranking.

All of them work on many queries at once: one plan for N questions, partitioned by question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import nearest

WORD = r"[\p{L}\p{N}]+"


def candidate_limit(limit: Column | int) -> Column:
    return F.least(F.greatest((limit if isinstance(limit, Column) else F.lit(limit)) * 5, F.lit(50)), F.lit(200))


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; the rank filter lets Spark cut each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def dense(queries: DataFrame, passages: DataFrame, k: int, digits: int = 6, same_id: bool = False, native: bool = False, most: int | None = None) -> DataFrame:
    """query_id, vec_id, score and rank by cosine over all ``passages`` (vec_id, embedding), for a stated query set.

    ``queries`` (query_id, embedding) may grow with the passages: blocks of both meet as matrix products, or with ``native``
    as expressions, and what can't be among the first k is gone before it is rounded and ranked. Filters on passages come
    before the distance, so that history dates aren't underfilled. Scores are rounded and ties go to the smaller id. There
    are no more than ``most`` passages, if it is given; it saves their count.
    """
    near = (nearest.by_expressions if native else nearest.by_blocks)(queries, passages, k, 2 * 10.0**-digits, same_id, most)
    return top(near.withColumn("score", F.round("score", digits)), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


#: What a term counts by the field that holds it.
FIELD_POINTS = {"title": 3, "heading": 2, "content": 1}


def keyword_matches(queries: DataFrame, passages: DataFrame, same_id: bool = False) -> DataFrame:
    """``queries`` (query_id, terms, anchor) against ``passages`` (passage_id, title, heading, content), by whole words.

    An inverted list: the distinct words of each field meet the terms by an equi-join, so only passages with a term of
    the query come out, and one aggregation gives what every score and every stage of the cascade needs: n_terms,
    matched (the distinct terms, at most a query's few), anchored, points (3, 2, 1 by field), title_terms, text_terms and
    text_points (both without the title). Passages without a term, and queries without terms, give no row.
    """

    def words(field: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(WORD), F.lit(0)))
        return F.transform(found, lambda w: F.struct(w.alias("term"), F.lit(FIELD_POINTS[field]).alias("points")))

    postings = passages.select("passage_id", F.inline(F.concat(*[words(field) for field in FIELD_POINTS])))
    asked = queries.select("query_id", F.size("terms").alias("n_terms"), "anchor", F.explode("terms").alias("term"))
    met = postings.join(asked, "term")
    if not same_id:
        met = met.where("query_id <> passage_id")
    in_text = F.col("points") < FIELD_POINTS["title"]
    return met.groupBy("query_id", "passage_id").agg(
        F.max("n_terms").alias("n_terms"), F.collect_set("term").alias("matched"), F.bool_or(F.col("term") == F.col("anchor")).alias("anchored"), F.sum("points").alias("points"),
        F.count_if(~in_text).alias("title_terms"), F.size(F.collect_set(F.when(in_text, F.col("term")))).alias("text_terms"), F.sum(F.when(in_text, F.col("points")).otherwise(0)).alias("text_points"),
    )


def boolean_scores(matches: DataFrame) -> DataFrame:
    """Passages whose title, or whose text, holds all terms: 3 for the title and, for the text, its points, at least 1."""
    by_title, by_text = F.col("title_terms") == F.col("n_terms"), F.col("text_terms") == F.col("n_terms")
    score = F.when(by_title, 3).otherwise(0) + F.when(by_text, F.greatest("text_points", F.lit(1))).otherwise(0)
    return matches.where(by_title | by_text).withColumn("score", score)


def _stage_flags() -> dict[str, Column]:
    """Which stages of the cascade accept a passage; two matches are only a pool, from which the anchor picks."""
    n = F.size("matched")
    two = n >= F.least(F.lit(2), F.col("n_terms"))
    return {"all_terms": n == F.col("n_terms"), "minimum_two": two, "anchor_required": two & F.col("anchored")}


def cascade(matches: DataFrame, k: int) -> DataFrame:
    """The first k passages of each query by the first stage that accepts one: all terms, or two with the anchor; else none."""
    flags = _stage_flags()
    stage = F.when(flags["all_terms"], "all_terms").when(flags["anchor_required"], "anchor_required")
    kept = matches.withColumn("strategy", stage).where("strategy is not null")
    w = Window.partitionBy("query_id").orderBy("strategy", F.desc("points"), "passage_id")  # all_terms sorts first
    first = kept.withColumn("best", F.first("strategy").over(w)).withColumn("rank", F.row_number().over(w))
    return first.where((F.col("rank") <= k) & (F.col("strategy") == F.col("best"))).drop("best")


def cascade_stages(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, place, stage, accepted and status of the stages each query went through, for its diagnostics.

    The walk ends at the first match. Below three terms the later plans equal the first and are skipped; a query that no
    stage answers ends in insufficient_evidence. Queries without any match are kept.
    """
    counts = matches.groupBy("query_id").agg(*[F.count_if(f).alias(f"n_{name}") for name, f in _stage_flags().items()])
    rows = queries.select("query_id", "anchor", F.size("terms").alias("n_terms")).join(counts, "query_id", "left").na.fill(0, ["n_all_terms", "n_minimum_two", "n_anchor_required"])
    every, two, anchored = (F.col(f"n_{name}") for name in ("all_terms", "minimum_two", "anchor_required"))
    same_plan = F.col("n_terms") <= 2
    stage = lambda name, n, status: F.struct(F.lit(name).alias("stage"), n.cast("long").alias("accepted"), status.alias("status"))
    walked = [
        stage("all_terms", every, F.when(every > 0, "matched").otherwise("no_match")),
        F.when(every == 0, stage("minimum_two", two, F.when(two > 0, "candidate_pool").when(same_plan, "skipped_duplicate_query").otherwise("no_match"))),
        F.when(every == 0, stage("anchor_required", anchored, F.when(anchored > 0, "matched").when(F.col("anchor").isNull(), "skipped_no_anchor").when(same_plan, "skipped_duplicate_query").otherwise("no_match"))),
        F.when((every == 0) & (anchored == 0), stage("insufficient_evidence", F.lit(0), F.lit("insufficient_evidence"))),
    ]
    return rows.select("query_id", F.posexplode(F.filter(F.array(*walked), lambda x: x.isNotNull())).alias("place", "s")).select("query_id", "place", "s.*")


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int = 60, most: int = 50) -> DataFrame:
    """query_id, item_id and the sum of 1 / (k + rank) over two ranked lists, each cut at ``most``."""
    left = a.where(F.col("rank") <= most).select("query_id", "item_id", F.col("rank").alias("rank_a"))
    right = b.where(F.col("rank") <= most).select("query_id", "item_id", F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return left.join(right, ["query_id", "item_id"], "full").withColumn("score", part("rank_a") + part("rank_b"))


def min_max_by_query(hits: DataFrame, query: str = "query_id", score: str = "score", rank: str = "rank") -> DataFrame:
    """Scores to [0, 1] within a query; if all are equal, from 1 down by ninths of the rank."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("normalised", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1 - (F.col(rank) - 1) / 9.0))


def rerank(hits: DataFrame, concept: Column, heading: Column, complete: Column, active: Column) -> DataFrame:
    """New ranks by 0.35 vector + 0.30 concept + 0.25 heading + 0.10 completeness; without an active concept by vector."""
    normal = min_max_by_query(hits)
    mixed = 0.35 * F.col("normalised") + 0.30 * concept + 0.25 * heading + 0.10 * complete
    scored = normal.withColumn("new_score", F.round(F.when(active, mixed).otherwise(F.col("normalised")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank", "vec_id")
    return scored.withColumn("new_rank", F.row_number().over(w))


def keyset_page(rows: DataFrame, stamp: str, key: str, cursor: tuple | None, limit: int) -> DataFrame:
    """A page in descending (stamp, key) order after ``cursor``; one row more than ``limit`` tells that there is another."""
    if cursor is not None:
        a, b = (F.lit(x) for x in cursor)
        rows = rows.where((F.col(stamp) < a) | ((F.col(stamp) == a) & (F.col(key) < b)))
    return rows.orderBy(F.desc(stamp), F.desc(key)).limit(limit + 1)


def encode_cursor(stamp: Column, key: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(stamp.alias("at"), key.alias("id"))), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    return F.from_json(F.decode(F.unbase64(cursor), "UTF-8"), "at string, id bigint")


def near_duplicate_pairs(rows: DataFrame, least: float, key: str = "id", text: str = "text") -> DataFrame:
    """Pairs (left_id, right_id, similarity) of short texts whose distinct trigrams have a Jaccard of at least ``least``.

    Prefix filtering: only trigrams among the rarest n - ceil(least * n) + 1 of a text can be the rarest that a pair
    shares, so each text joins on those, and lengths outside the ratio are dropped before sets are compared.
    """
    from chronolex.functions.text import trigrams

    sets = rows.select(F.col(key).alias("id"), F.array_sort(trigrams(F.col(text))).alias("grams")).where(F.size("grams") > 0)
    frequency = sets.select(F.explode("grams").alias("g")).groupBy("g").count()
    ranked = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(frequency, "g")
    w = Window.partitionBy("id").orderBy("count", "g")
    prefix = ranked.withColumn("p", F.row_number().over(w)).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "n", "g")
    a, b = prefix.alias("a"), prefix.alias("b")
    found = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least))
    pairs = found.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("left_id"), F.col("grams").alias("x")), "left_id").join(sets.select(F.col("id").alias("right_id"), F.col("grams").alias("y")), "right_id")
    shared, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return full.select("left_id", "right_id", (shared / union).alias("similarity")).where(F.col("similarity") >= least)
