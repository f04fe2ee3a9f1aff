"""Retrieval composites: direct lookup, vector and keyword search, cascade, fusion, reranking, context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions import references as R
from chronolex.functions import text as X
from chronolex.functions import vectors as V
from chronolex.operators import retrieval, selection, temporal
from chronolex.plans.aggregates import HITS, budget_walk, hits
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query
from chronolex.plans.scans import AS_OF, ROUTE, as_of, route_of


#: Questions that name a document and its articles, by every fiftieth customer: two articles, a range, a range that runs
#: backwards, and a title that no document has.
_ASKED = (" 제2조 및 제4조는?", " 제1조부터 제3조까지", " 제5조부터 제2조까지", " 제1조는?")


@query("q_direct_path", f"""WITH {VERSIONS}, asked AS (SELECT c_custkey AS query_id, c_custkey // 50 % 4 AS kind FROM customer WHERE c_custkey % 50 = 0),
paths AS (SELECT query_id, unnest(CASE kind WHEN 0 THEN [2, 4] WHEN 1 THEN [1, 2, 3] ELSE [] END) AS n FROM asked),
found AS (SELECT query_id, version_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n, version_id) AS rank FROM paths JOIN versions ON document_id = query_id JOIN lineitem ON l_orderkey = version_id AND l_linenumber = n WHERE {AS_OF} AND {SEARCHABLE})
SELECT query_id, CASE kind WHEN 2 THEN 'descending_range' WHEN 3 THEN 'unknown_title' ELSE 'ok' END AS status, version_id, '제' || n || '조' AS path, CAST(rank AS INTEGER) AS rank FROM asked LEFT JOIN (SELECT * FROM found WHERE rank <= 10) USING (query_id)""")
def q_direct_path(t):
    """Questions read as a title and paths, then provisions by title and path as of a date; never a lexical search.

    The questions name customers as documents, and lines of orders are their articles. An unknown title or a refused
    range keeps its row with the reason and finds nothing.
    """
    tail = F.element_at(F.array(*[F.lit(x) for x in _ASKED]), (F.floor(F.col("c_custkey") / 50) % 4 + 1).cast("int"))
    name = F.when(F.floor(F.col("c_custkey") / 50) % 4 == 3, F.concat(F.lit("No "), "c_name")).otherwise(F.col("c_name"))
    asked = t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(name, tail).alias("question"))
    titles = t.customer.select(F.lower(F.col("c_name")).alias("title"), F.col("c_custkey").alias("document_id"))
    read = asked.select("query_id", R.with_arabic_numbers(F.col("question")).alias("q"))
    read = read.select("query_id", F.lower(F.regexp_extract("q", r"^(.*?)\s*제\s*\d", 1)).alias("title"), R.references(F.col("q")).alias("r")).join(titles, "title", "left")
    status = F.when(F.col("document_id").isNull(), "unknown_title").otherwise(F.coalesce("r.invalid", F.lit("ok")))
    read = read.select("query_id", "document_id", status.alias("status"), "r.paths")
    wanted = read.where("status = 'ok'").select("query_id", "document_id", F.explode("paths").alias("path"))
    current = t.versions.where(as_of()).where(temporal.searchable()).select("document_id", "version_id")
    lines = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("제"), "l_linenumber", F.lit("조")).alias("path"))
    found = retrieval.top(wanted.join(current, "document_id").join(lines, ["version_id", "path"]), ["query_id"], [F.asc("n"), F.asc("version_id")], 10)
    return read.select("query_id", "status").join(found.select("query_id", "version_id", "path", "rank"), "query_id", "left")


_DENSE = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT * FROM v WHERE {keep}),
s AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, round(list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(p.e, p.e)), 6) AS score FROM v q JOIN f p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE true)"""


def _dense(t, keep, k):
    v = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("embedding"))
    return retrieval.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.where(keep), k)


@query("q_dense", _DENSE.format(keep="true") + " SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r WHERE rank <= 50) WHERE n = 1")
def q_dense(t):
    rows = _dense(t, "true", 50).select("*", F.col("label").alias("document_id"), F.concat(F.lit("a"), F.col("label")).alias("path"))
    return temporal.first_per_article(rows, ["query_id"], [F.asc("rank")]).select("query_id", "vec_id", "score")


@query("q_dense_raw", _DENSE.format(keep="true") + " SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200")
def q_dense_raw(t):
    return _dense(t, "true", 200).select("query_id", "vec_id", "rank")


@query("q_as_of_dense", f"""WITH {VERSIONS}, valid AS (SELECT DISTINCT document_id FROM versions WHERE {AS_OF}), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, round(list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(p.e, p.e)), 6) AS score FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND p.vec_id IN (SELECT document_id FROM valid))
SELECT query_id, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 11""")
def q_as_of_dense(t):
    """History dates keep all their hits: the date filter stands before the distance and the limit."""
    valid = t.versions.where(as_of()).select(F.col("document_id").alias("vec_id")).distinct()
    v = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("embedding"))
    return retrieval.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.join(valid, "vec_id", "left_semi"), 11, most=v.count()).select("query_id", "vec_id", "label", "score", "rank")


STOP = ("the", "of", "and")


def questions(t):
    """Every fiftieth document as a question: its first terms, and the longest of them as anchor."""
    q = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text", X.terms(F.coalesce("text", F.lit("")), STOP).alias("terms"))
    longest = F.get(F.array_sort(F.transform("terms", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), F.lit(0))["w"]
    return q.withColumn("anchor", longest)


def passages(t):
    """Documents as passages: the first line is the title, the second the heading, the rest the content."""
    lines = F.split("text", "\n", 3)
    return t.documents.select(F.col("doc_id").alias("passage_id"), *[F.get(lines, F.lit(i)).alias(c) for i, c in enumerate(("title", "heading", "content"))])


def _matches(t):
    return retrieval.keyword_matches(questions(t), passages(t))


KEYWORD = r"""q AS (SELECT query_id, text, terms, CASE WHEN len(terms) > 0 THEN list_sort(list_transform(terms, lambda w: {'l': -length(w), 'w': w}))[1].w END AS anchor FROM (
  SELECT query_id, text, list_transform(list_slice(list_sort(list_transform(list_distinct(ws), lambda w: list_position(ws, w))), 1, 5), lambda p: ws[p]) AS terms FROM (
  SELECT doc_id AS query_id, text, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'and')) AS ws FROM documents WHERE doc_id % 50 = 0))),
lines AS (SELECT doc_id AS passage_id, string_split(lower(text), chr(10)) AS l FROM documents),
postings AS (SELECT passage_id, points, unnest(list_distinct(regexp_extract_all(field, '[\p{L}\p{N}]+'))) AS term FROM (
  SELECT passage_id, 3 AS points, l[1] AS field FROM lines UNION ALL SELECT passage_id, 2, coalesce(l[2], '') FROM lines UNION ALL SELECT passage_id, 1, array_to_string(l[3:], chr(10)) FROM lines)),
k AS (SELECT query_id, passage_id, n_terms, sum(points) AS points, count(DISTINCT term) AS n, bool_or(term = anchor) AS anchored, count(*) FILTER (points = 3) AS title_terms,
  count(DISTINCT term) FILTER (points < 3) AS text_terms, coalesce(sum(points) FILTER (points < 3), 0) AS text_points
  FROM postings JOIN (SELECT query_id, len(terms) AS n_terms, anchor, unnest(terms) AS term FROM q) USING (term) WHERE query_id <> passage_id GROUP BY query_id, passage_id, n_terms)"""
CASCADE = """staged AS (SELECT query_id, passage_id, points, CASE WHEN n = n_terms THEN 'all_terms' WHEN n >= least(2, n_terms) AND anchored THEN 'anchor_required' END AS strategy FROM k),
best AS (SELECT *, min(strategy) OVER (PARTITION BY query_id) AS best FROM staged WHERE strategy IS NOT NULL),
answers AS (SELECT query_id, passage_id, strategy, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, passage_id) AS rank FROM best WHERE strategy = best)"""


@query("q_keyword_memory", f"WITH {KEYWORD} SELECT query_id, passage_id, CAST(points AS BIGINT) AS score FROM k")
def q_keyword_memory(t):
    return _matches(t).select("query_id", "passage_id", F.col("points").alias("score"))


@query("q_keyword_scored", f"""WITH {KEYWORD}, s AS (SELECT query_id, passage_id, CASE WHEN title_terms = n_terms THEN 3 ELSE 0 END + CASE WHEN text_terms = n_terms THEN greatest(text_points, 1) ELSE 0 END AS score FROM k WHERE title_terms = n_terms OR text_terms = n_terms)
SELECT query_id, passage_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s) WHERE rank <= 10""")
def q_keyword_scored(t):
    return retrieval.top(retrieval.boolean_scores(_matches(t)), ["query_id"], [F.desc("score"), F.asc("passage_id")], 10).select("query_id", "passage_id", "score", "rank")


@query("q_four_stage_cascade", f"WITH {KEYWORD}, {CASCADE} SELECT query_id, passage_id, strategy, CAST(rank AS INTEGER) AS rank FROM answers WHERE rank <= 10")
def q_four_stage_cascade(t):
    return retrieval.cascade(_matches(t), 10).select("query_id", "passage_id", "strategy", "rank")


@query("q_cascade_stages", f"""WITH {KEYWORD}, c AS (SELECT query_id, count(*) FILTER (n = n_terms) AS every, count(*) FILTER (n >= least(2, n_terms)) AS two, count(*) FILTER (n >= least(2, n_terms) AND anchored) AS held FROM k GROUP BY query_id),
a AS (SELECT query_id, anchor, len(terms) AS n_terms, coalesce(every, 0) AS every, coalesce(two, 0) AS two, coalesce(held, 0) AS held FROM q LEFT JOIN c USING (query_id))
SELECT query_id, 'all_terms' AS stage, every AS accepted, CASE WHEN every > 0 THEN 'matched' ELSE 'no_match' END AS status FROM a
UNION ALL SELECT query_id, 'minimum_two', two, CASE WHEN two > 0 THEN 'candidate_pool' WHEN n_terms <= 2 THEN 'skipped_duplicate_query' ELSE 'no_match' END FROM a WHERE every = 0
UNION ALL SELECT query_id, 'anchor_required', held, CASE WHEN held > 0 THEN 'matched' WHEN anchor IS NULL THEN 'skipped_no_anchor' WHEN n_terms <= 2 THEN 'skipped_duplicate_query' ELSE 'no_match' END FROM a WHERE every = 0
UNION ALL SELECT query_id, 'insufficient_evidence', 0, 'insufficient_evidence' FROM a WHERE every = 0 AND held = 0""")
def q_cascade_stages(t):
    return retrieval.cascade_stages(questions(t), _matches(t)).select("query_id", "stage", "accepted", "status")


@query("q_hybrid_rrf", f"""WITH {KEYWORD}, {HITS.replace('rank <= 10', 'rank <= 50')}, a AS (SELECT query_id, passage_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, passage_id) AS r FROM k),
x AS (SELECT * FROM a WHERE r <= 50), y AS (SELECT query_id, vec_id AS item_id, rank AS r FROM hits)
SELECT query_id, item_id, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0), 9) AS score FROM x FULL JOIN y USING (query_id, item_id)""")
def q_hybrid_rrf(t):
    """The first fifty by keywords and the first fifty by vectors of the same questions, fused by their ranks."""
    words = retrieval.top(_matches(t), ["query_id"], [F.desc("points"), F.asc("passage_id")], 50).withColumnRenamed("passage_id", "item_id")
    vectors = hits(t, 50).withColumnRenamed("vec_id", "item_id")
    return retrieval.reciprocal_rank_fusion(words, vectors).select("query_id", "item_id", F.round("score", 9).alias("score"))


@query("q_provision_lookup", f"WITH {VERSIONS} SELECT version_id, effective_from FROM versions WHERE version_id = 7 AND {AS_OF.replace('1996-06-30', '2000-08-01')}")
def q_provision_lookup(t):
    return t.versions.where("version_id = 7").where(as_of("2000-08-01")).select("version_id", "effective_from")


@query("q_corpus_status", f"WITH {VERSIONS} SELECT ministry, count(*) AS n, max(effective_from) AS latest, count(*) FILTER (effective_to IS NULL) AS n_open FROM versions GROUP BY ministry")
def q_corpus_status(t):
    return t.versions.groupBy("ministry").agg(F.count("*").alias("n"), F.max("effective_from").alias("latest"), F.count_if(F.col("effective_to").isNull()).alias("n_open"))


_RERANK = """, n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 - (rank - 1) / 9.0 END AS nm FROM hits WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT *, round(CASE WHEN query_id % 2 = 0 THEN 0.35 * nm + 0.30 * (CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END) + 0.25 * (CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END) + 0.10 * (CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0.0 END) ELSE nm END, 9) AS new_score FROM n),
x AS (SELECT query_id, vec_id, label, rank, new_score, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank, vec_id) AS new_rank FROM m)"""


def _reranked(t):
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return retrieval.rerank(hits(t), flag(F.col("label") % 2 == 0), flag(F.col("label") == 3), flag(F.col("vec_id") % 5 == 0), F.col("query_id") % 2 == 0)


@query("q_rerank_concept", f"WITH {HITS}{_RERANK} SELECT query_id, vec_id, new_score, CAST(new_rank AS INTEGER) AS new_rank FROM x")
def q_rerank_concept(t):
    return _reranked(t).select("query_id", "vec_id", "new_score", "new_rank")


@query("agg_rerank_compare", f"WITH {HITS}{_RERANK} SELECT k, count(DISTINCT query_id) FILTER (rank <= k AND label = query_id % 10) AS before, count(DISTINCT query_id) FILTER (new_rank <= k AND label = query_id % 10) AS after FROM x CROSS JOIN (VALUES (1), (3), (5), (10)) AS v(k) GROUP BY k")
def agg_rerank_compare(t):
    ks = t.spark.createDataFrame([(1,), (3,), (5,), (10,)], "k int")
    right = F.col("label") == F.col("query_id") % 10
    rows = _reranked(t).crossJoin(F.broadcast(ks))
    hit = lambda rank: F.count_distinct(F.when((F.col(rank) <= F.col("k")) & right, F.col("query_id")))
    return rows.groupBy("k").agg(hit("rank").alias("before"), hit("new_rank").alias("after"))


@query("q_context_package", f"WITH {PROVISIONS}, x AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY ordinal) AS body, count(*) AS n FROM provisions GROUP BY doc_id) SELECT doc_id, CASE WHEN length(body) > 5000 THEN 'too_long' WHEN n = 1 THEN 'single' WHEN contains(body, 'License') THEN 'license' ELSE 'ready' END AS status FROM x")
def q_context_package(t):
    x = selection.subtree_text(t.provisions, ["doc_id"], "ordinal", "content")
    status = F.when(F.length("text") > 5000, "too_long").when(F.col("n_nodes") == 1, "single").when(F.contains("text", F.lit("License")), "license").otherwise("ready")
    return x.select("doc_id", status.alias("status"))


_BUDGETS = budget_walk("[3000, 6000, 60000]", 5, False)


@query("q_context_assembly", f"WITH RECURSIVE {_BUDGETS} SELECT budget, query_id, used, len(chosen) AS n_chosen, budget_exceeded FROM walked")
def q_context_assembly(t):
    lengths = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("n_chars"))
    budgets = F.explode(F.array(*[F.lit(b) for b in (3000, 6000, 60000)])).alias("budget")
    rows = hits(t).join(lengths, "vec_id").select("*", budgets)
    walked = selection.greedy_budget(rows, ["budget", "query_id"], "rank", "n_chars", "vec_id", 5, F.col("budget"), first_exempt=False)
    return walked.select("budget", "query_id", "used", F.size("chosen").alias("n_chosen"), "budget_exceeded")


@query("agg_combo_report", f"WITH RECURSIVE {_BUDGETS} SELECT budget, avg(used) AS avg_chars, round_even(avg(used / 2.2), 4) AS avg_tokens, avg(len(chosen)) AS avg_articles, count(*) FILTER (budget_exceeded) AS exceeded FROM walked GROUP BY budget")
def agg_combo_report(t):
    rows = q_context_assembly(t)
    return rows.groupBy("budget").agg(F.avg("used").alias("avg_chars"), F.bround(F.avg(F.col("used") / 2.2), 4).alias("avg_tokens"), F.avg("n_chosen").alias("avg_articles"), F.count_if("budget_exceeded").alias("exceeded"))


@query("q_search_only_answer", f"WITH {HITS} SELECT query_id, string_agg('C' || rank || ':' || vec_id, ' ' ORDER BY rank) AS citations, CASE WHEN max(score) < 0.2 THEN 'no_result' ELSE 'hits' END AS status FROM hits WHERE rank <= 5 GROUP BY query_id")
def q_search_only_answer(t):
    cited = F.array_sort(F.collect_list(F.struct("rank", "vec_id")))
    labels = F.transform(cited, lambda c: F.concat(F.lit("C"), c["rank"], F.lit(":"), c["vec_id"]))
    return hits(t, 5).groupBy("query_id").agg(F.array_join(labels, " ").alias("citations"), F.when(F.max("score") < 0.2, "no_result").otherwise("hits").alias("status"))


@query("q_route_blocked", "SELECT item_id, 'The question ' || item_id || ' (' || length(text) || ' characters) is ' || CASE WHEN length(text) > 250 THEN 'too long' ELSE 'not a search' END || '.' AS answer FROM benchmark")
def q_route_blocked(t):
    return t.benchmark.select("item_id", F.format_string("The question %d (%d characters) is %s.", "item_id", F.length("text"), F.when(F.length("text") > 250, "too long").otherwise("not a search")).alias("answer"))


EVIDENCE = f"""routed AS (SELECT query_id, len(terms) AS n_terms, {ROUTE} AS route FROM q),
open AS (SELECT query_id FROM routed WHERE route <> 'realtime' AND n_terms >= 2), by_words AS (SELECT query_id, passage_id AS item_id, rank FROM answers JOIN open USING (query_id) WHERE rank <= 10),
evidence AS (SELECT query_id, 'keyword' AS channel, item_id, rank FROM by_words UNION ALL
  SELECT query_id, 'vector', vec_id, rank FROM hits JOIN open USING (query_id) WHERE score >= 0.2 AND query_id NOT IN (SELECT query_id FROM by_words))"""


def _routed(t):
    return questions(t).select("query_id", F.size("terms").alias("n_terms"), route_of(F.col("text")).alias("route"))


def _by_words(t):
    """Questions that are searched, and what the keyword cascade finds for them."""
    searched = _routed(t).where("coalesce(route, '') <> 'realtime' and n_terms >= 2").select("query_id")
    return searched, retrieval.cascade(_matches(t), 10).join(searched, "query_id", "left_semi").select("query_id", F.lit("keyword").alias("channel"), F.col("passage_id").alias("item_id"), "rank")


def evidence(t):
    """query_id, channel, item_id and rank: the keyword cascade's answers, and vector hits where it has none.

    Questions that are blocked by their route or too short to search find nothing.
    """
    searched, by_words = _by_words(t)
    unanswered = searched.join(by_words, "query_id", "left_anti")
    by_vectors = hits(t).where("score >= 0.2").join(unanswered, "query_id", "left_semi").select("query_id", F.lit("vector").alias("channel"), F.col("vec_id").alias("item_id"), "rank")
    return by_words.unionByName(by_vectors)


@query("q_question_pipeline", f"""WITH {KEYWORD}, {CASCADE}, {HITS}, {EVIDENCE}, e AS (SELECT query_id, max(channel) AS channel, count(*) AS n FROM evidence GROUP BY query_id)
SELECT query_id, route, coalesce(channel, 'none') AS channel, coalesce(n, 0) AS n_hits,
  CASE WHEN route = 'realtime' THEN 'blocked' WHEN n_terms < 2 THEN 'clarify' WHEN n IS NULL THEN 'no_result' WHEN n >= 2 THEN 'answered' ELSE 'search_only' END AS outcome FROM routed LEFT JOIN e USING (query_id)""")
def q_question_pipeline(t):
    """Route, keyword cascade, vector fallback and the gate before an answer, as one plan for all questions."""
    found = evidence(t).groupBy("query_id").agg(F.max("channel").alias("channel"), F.count("*").alias("n"))
    outcome = F.when(F.col("route") == "realtime", "blocked").when(F.col("n_terms") < 2, "clarify").when(F.col("n").isNull(), "no_result").when(F.col("n") >= 2, "answered").otherwise("search_only")
    joined = _routed(t).join(found, "query_id", "left")
    return joined.select("query_id", "route", F.coalesce("channel", F.lit("none")).alias("channel"), F.coalesce("n", F.lit(0)).alias("n_hits"), outcome.alias("outcome"))


@query("q_agent_graph", f"""WITH {KEYWORD}, {CASCADE}, {HITS}, {EVIDENCE}, found AS (SELECT query_id, list(item_id) AS ids FROM evidence GROUP BY query_id), draft AS (SELECT query_id, list(vec_id) AS cited FROM hits WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, CASE WHEN route = 'realtime' THEN 'blocked' WHEN ids IS NULL THEN 'no_evidence' WHEN cited IS NOT NULL AND list_has_all(ids, cited) THEN 'answer' ELSE 'rejected' END AS outcome FROM routed LEFT JOIN found USING (query_id) LEFT JOIN draft USING (query_id)""")
def q_agent_graph(t):
    """Route, search, draft and validation: a draft, which cites the two nearest vectors, goes out if the search found both."""
    searched, by_words = _by_words(t)
    words = by_words.groupBy("query_id").agg(F.collect_list(F.col("item_id").cast("string")).alias("by_words"))
    id_if = lambda c: F.collect_list(F.when(c, F.col("vec_id").cast("string")))
    near = hits(t).groupBy("query_id").agg(id_if(F.col("score") >= 0.2).alias("by_vectors"), id_if(F.col("rank") <= 2).alias("cited"))
    both = _routed(t).join(searched.withColumn("searched", F.lit(True)), "query_id", "left").join(words, "query_id", "left").join(near, "query_id", "left")
    rows = both.withColumn("ids", F.coalesce("by_words", F.when(F.col("searched") & (F.size("by_vectors") > 0), F.col("by_vectors"))))
    sections = F.array(F.struct(F.coalesce("cited", F.array().cast("array<string>")).alias("citation_ids")))
    valid = selection.structurally_grounded(sections, F.col("ids"), F.lit("answer"))
    return rows.select("query_id", F.when(F.col("route") == "realtime", "blocked").when(F.col("ids").isNull(), "no_evidence").when(valid, "answer").otherwise("rejected").alias("outcome"))


@query("q_v2_ready", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) = 'purchase' AS ready FROM events GROUP BY user_id")
def q_v2_ready(t):
    return t.events.groupBy("user_id").agg((F.max_by("event_type", F.struct("ts", "event_id")) == "purchase").alias("ready"))


@query("filter_prefilter_v2", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def filter_prefilter_v2(t):
    return t.orders.where(F.date_format("o_orderdate", "yyyy-MM-dd") <= "1996-06-30").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("validate_draft", f"""WITH {HITS}, ids AS (SELECT query_id, list('c' || vec_id) AS found FROM hits GROUP BY query_id)
SELECT query_id, list_contains(found, 'c' || ((query_id * 37) % 500)) AND query_id % 4 <> 0 AS grounded FROM ids""")
def validate_draft(t):
    found = hits(t).groupBy("query_id").agg(F.collect_list(F.concat(F.lit("c"), "vec_id")).alias("found"))
    cites = F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), (F.col("query_id") * 37) % 500)))
    sections = F.array(F.struct(F.lit("claim").alias("claim"), cites.alias("citation_ids")))
    return found.select("query_id", selection.structurally_grounded(sections, F.col("found"), F.lit("answer")).alias("grounded"))


@query("derive_action", "SELECT conv_id, CASE WHEN bool_or(contains(lower(text), 'license')) THEN 'check' WHEN count(*) FILTER (role = 'user') > 3 THEN 'ask' WHEN bool_or(role = 'system') THEN 'warn' ELSE 'answer' END AS action FROM conversations GROUP BY conv_id")
def derive_action(t):
    statuses = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count_if(F.col("role") == "user").alias("asked"), F.bool_or(F.contains(F.lower("text"), F.lit("license"))).alias("licensed"))
    action = F.when(F.col("licensed"), "check").when(F.col("asked") > 3, "ask").when(F.array_contains("roles", "system"), "warn").otherwise("answer")
    return statuses.select("conv_id", action.alias("action"))


@query("evidence_prefix_present", "SELECT b.item_id, contains(regexp_replace(lower(d.text), '\\s', '', 'g'), regexp_replace(lower(left(b.text, 12)), '\\s', '', 'g')) AS present FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3")
def evidence_prefix_present(t):
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    docs = t.documents.select("doc_id", bare(F.col("text")).alias("d"))
    return t.benchmark.join(docs, F.col("doc_id") == F.col("item_id") * 3).select("item_id", F.contains("d", bare(F.substring("text", 1, 12))).alias("present"))


@query("grounding_word_overlap", r"""SELECT b.item_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z]{2,}')), list_distinct(regexp_extract_all(lower(d.text), '[a-z]{2,}')))) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z]{2,}'))), 9) AS overlap
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 4 WHERE len(regexp_extract_all(lower(b.text), '[a-z]{2,}')) > 0""")
def grounding_word_overlap(t):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0)))
    docs = t.documents.select("doc_id", words("text").alias("d"))
    rows = t.benchmark.select("item_id", words("text").alias("b")).where(F.size("b") > 0).join(docs, F.col("doc_id") == F.col("item_id") * 4)
    return rows.select("item_id", F.round(F.size(F.array_intersect("b", "d")) / F.size("b"), 9).alias("overlap"))
