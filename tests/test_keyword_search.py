"""Keyword matches, the cascade and its stages against a plain walk over small passages."""

from pyspark.sql import types as T

from chronolex.operators import retrieval

QUERIES = [(1, ["red", "tax", "law"], "tax"), (2, ["blue", "sky"], "blue"), (3, ["green"], "green"), (4, [], None), (5, ["red", "old", "sea"], "sea")]
PASSAGES = [
    (10, "Red tax law", None, "nothing"), (11, "x", "tax", "red RED cats"), (12, "red", "law", "zoo"), (13, None, None, None), (14, "", "", "blue skyline"),
    (15, "old red", "Old", "old oak"), (16, "tax", "red", "law"), (1, "red tax law", "", ""),
]


def tables(spark):
    queries = spark.createDataFrame(QUERIES, "query_id long, terms array<string>, anchor string")
    passages = spark.createDataFrame(PASSAGES, "passage_id long, title string, heading string, content string")
    return queries, passages


def plain(terms, anchor, passage):
    fields = [set((f or "").lower().split()) for f in passage[1:]]
    hits = {t: [t in f for f in fields] for t in terms if any(t in f for f in fields)}
    return set(hits), sum(3 * a + 2 * b + c for a, b, c in hits.values())


def test_matches_and_boolean_scores(spark):
    queries, passages = tables(spark)
    found = {(r.query_id, r.passage_id): (set(r.matched), r.points) for r in retrieval.keyword_matches(queries, passages).collect()}
    want = {(q, p[0]): plain(terms, anchor, p) for q, terms, anchor in QUERIES for p in PASSAGES if q != p[0]}
    assert found == {k: v for k, v in want.items() if v[0]}
    scored = {(r.query_id, r.passage_id): r.score for r in retrieval.boolean_scores(retrieval.keyword_matches(queries, passages)).collect()}
    assert scored == {(1, 10): 3}


def test_cascade_takes_two_terms_only_with_the_anchor(spark):
    queries, passages = tables(spark)
    got = {(r.query_id, r.passage_id, r.strategy, r["rank"]) for r in retrieval.cascade(retrieval.keyword_matches(queries, passages), 10).collect()}
    assert got == {(1, 10, "all_terms", 1), (1, 16, "all_terms", 2)}


def test_every_stage_leaves_its_status(spark):
    queries, passages = tables(spark)
    rows = retrieval.cascade_stages(queries, retrieval.keyword_matches(queries, passages)).orderBy("query_id", "place").collect()
    got = [(r.query_id, r.stage, r.accepted, r.status) for r in rows]
    none = ("insufficient_evidence", 0, "insufficient_evidence")
    assert got == [
        (1, "all_terms", 2, "matched"),
        (2, "all_terms", 0, "no_match"), (2, "minimum_two", 0, "skipped_duplicate_query"), (2, "anchor_required", 0, "skipped_duplicate_query"), (2, *none),
        (3, "all_terms", 0, "no_match"), (3, "minimum_two", 0, "skipped_duplicate_query"), (3, "anchor_required", 0, "skipped_duplicate_query"), (3, *none),
        (4, "all_terms", 0, "no_match"), (4, "minimum_two", 0, "skipped_duplicate_query"), (4, "anchor_required", 0, "skipped_no_anchor"), (4, *none),
        (5, "all_terms", 0, "no_match"), (5, "minimum_two", 1, "candidate_pool"), (5, "anchor_required", 0, "no_match"), (5, *none),
    ]


def test_empty_tables(spark):
    queries, passages = tables(spark)
    assert retrieval.keyword_matches(queries, passages.limit(0)).count() == 0
    assert retrieval.cascade_stages(queries.limit(0), retrieval.keyword_matches(queries.limit(0), passages)).count() == 0
    assert isinstance(retrieval.cascade(retrieval.keyword_matches(queries, passages), 3).schema["strategy"].dataType, T.StringType)
