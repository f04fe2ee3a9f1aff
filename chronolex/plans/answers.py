"""The whole way from a question to an answer that may go out, and the state of the corpus that it is asked of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions import references as R
from chronolex.operators import selection, temporal
from chronolex.plans.aggregates import HITS, budget_walk
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query
from chronolex.plans.retrieval import CASCADE, EVIDENCE, KEYWORD, _routed, evidence
from chronolex.plans.scans import AS_OF, as_of
from chronolex.sources.shared import new_folder

_WAYS = f"""{KEYWORD}, {CASCADE}, {HITS}, {EVIDENCE}, {PROVISIONS},
direct AS (SELECT query_id, doc_id AS item_id FROM open JOIN provisions ON doc_id = query_id + 1 AND ordinal = query_id // 50 % 3 WHERE query_id % 150 = 0),
found AS (SELECT query_id, 'direct' AS channel, item_id, 1 AS rank FROM direct UNION ALL SELECT * FROM evidence WHERE query_id NOT IN (SELECT query_id FROM direct)),
costs AS (SELECT query_id, item_id AS vec_id, coalesce(n_chars, 0) AS n_chars, row_number() OVER (PARTITION BY query_id ORDER BY rank, item_id) AS n FROM found JOIN documents ON doc_id = item_id)"""


def _found(t):
    """query_id, channel, item_id, rank: what a question names directly, else what words find, else what vectors find."""
    searched = _routed(t).where("coalesce(route, '') <> 'realtime' and n_terms >= 2").select("query_id")
    named = F.concat(F.lit("문서 "), F.col("query_id") + 1, F.lit(" 제"), F.floor(F.col("query_id") / 50) % 3 + 1, F.lit("조는?"))
    asked = searched.where("query_id % 150 = 0").select("query_id", R.with_arabic_numbers(named).alias("q"))
    read = asked.select("query_id", F.regexp_extract("q", r"^문서 (\d+) 제", 1).cast("long").alias("doc_id"), F.explode(R.references(F.col("q"))["paths"]).alias("path"))
    lines = t.provisions.select("doc_id", F.concat(F.lit("제"), F.col("ordinal") + 1, F.lit("조")).alias("path"))
    direct = read.join(lines, ["doc_id", "path"]).select("query_id", F.lit("direct").alias("channel"), F.col("doc_id").alias("item_id"), F.lit(1).alias("rank"))
    return direct.unionByName(evidence(t).join(direct.select("query_id").distinct(), "query_id", "left_anti"))


@query("q_question_answering", f"""WITH RECURSIVE {budget_walk("[6000]", 5, True, _WAYS)}, c AS (SELECT query_id, max(channel) AS channel, list(DISTINCT item_id) AS ids FROM found GROUP BY query_id),
d AS (SELECT query_id, used, len(chosen) AS n_chosen, list_concat(list_slice(chosen, 1, 2), CASE WHEN query_id // 50 % 5 = 4 THEN [-1] ELSE [] END) AS cited FROM walked)
SELECT query_id, route, coalesce(channel, 'none') AS channel, coalesce(len(ids), 0) AS n_found, coalesce(n_chosen, 0) AS n_chosen, coalesce(used, 0) AS used, array_to_string(cited, ',') AS cited,
  CASE WHEN route = 'realtime' THEN 'blocked' WHEN n_terms < 2 THEN 'clarification_required' WHEN ids IS NULL THEN 'unanswerable' WHEN NOT list_has_all(ids, cited) THEN 'rejected' ELSE 'answer' END AS outcome
FROM routed LEFT JOIN c USING (query_id) LEFT JOIN d USING (query_id)""")
def q_question_answering(t):
    """Route, direct references, words, vectors, context under a budget, a draft that cites it, and the gate on its citations.

    What was found is written once and read by the context, the draft and the gate. Drafts cite the first two passages of
    their context; every fifth cites one that wasn't found.
    """
    folder = new_folder(t.spark, "found")
    _found(t).write.parquet(folder)
    found = t.spark.read.schema("query_id long, channel string, item_id long, rank int").parquet(folder)
    sizes = t.documents.select(F.col("doc_id").alias("item_id"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    costs = found.join(sizes, "item_id").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id")))
    context = selection.greedy_budget(costs, "query_id", "n", "n_chars", "item_id", 5, 6000).select("query_id", "used", "chosen")
    wrong = F.when(F.floor(F.col("query_id") / 50) % 5 == 4, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    draft = context.select("query_id", "used", F.size("chosen").alias("n_chosen"), F.concat(F.slice("chosen", 1, 2), wrong).alias("cited"))
    known = found.groupBy("query_id").agg(F.max("channel").alias("channel"), F.collect_set("item_id").alias("ids"))
    rows = _routed(t).join(known, "query_id", "left").join(draft, "query_id", "left")
    valid = selection.structurally_grounded(F.array(F.struct(F.col("cited").alias("citation_ids"))), F.col("ids"), F.lit("answer"))
    outcome = F.when(F.col("route") == "realtime", "blocked").when(F.col("n_terms") < 2, "clarification_required").when(F.col("ids").isNull(), "unanswerable").when(valid, "answer").otherwise("rejected")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "query_id", "route", F.coalesce("channel", F.lit("none")).alias("channel"), zero(F.when(F.col("ids").isNotNull(), F.size("ids"))).cast("long").alias("n_found"), zero("n_chosen").cast("long").alias("n_chosen"),
        zero("used").alias("used"), F.array_join("cited", ",").alias("cited"), outcome.alias("outcome"),
    )


@query("corpus_status_by_ministry", f"""WITH {VERSIONS}, v AS (SELECT *, {SEARCHABLE} AS searchable, {AS_OF} AS valid FROM versions), s AS (SELECT max(ts) FILTER (event_type = 'purchase') AS last_success, max(ts) AS last_run, arg_max(event_type, (ts, event_id)) AS last_kind FROM events)
SELECT ministry, count(DISTINCT document_id) AS documents, count(*) AS versions, count(DISTINCT document_id) FILTER (searchable AND valid) AS current_documents, count(*) FILTER (lifecycle_state = 'scheduled') AS scheduled, count(*) FILTER (record_state = 'deleted') AS deleted,
  min(effective_from) AS first_day, max(effective_from) AS last_day, CASE WHEN count(*) FILTER (searchable AND valid) = 0 THEN 'not_prepared' WHEN count(*) FILTER (valid AND NOT searchable) > 0 THEN 'degraded' ELSE 'ready' END AS state,
  CAST(any_value(last_success) AS DATE) AS last_success, any_value(last_kind) AS last_kind FROM v, s GROUP BY ministry""")
def corpus_status_by_ministry(t):
    """Catalog counts, the temporal state as of a day, and the last synchronisation, in one pass over versions and one over runs."""
    v = t.versions.withColumn("searchable", F.coalesce(temporal.searchable(), F.lit(False))).withColumn("valid", F.coalesce(as_of(), F.lit(False)))
    good = F.col("searchable") & F.col("valid")
    state = F.when(F.count_if(good) == 0, "not_prepared").when(F.count_if(F.col("valid") & ~F.col("searchable")) > 0, "degraded").otherwise("ready")
    catalog = v.groupBy("ministry").agg(
        F.count_distinct("document_id").alias("documents"), F.count("*").alias("versions"), F.count_distinct(F.when(good, F.col("document_id"))).alias("current_documents"), F.count_if(F.col("lifecycle_state") == "scheduled").alias("scheduled"),
        F.count_if(F.col("record_state") == "deleted").alias("deleted"), F.min("effective_from").alias("first_day"), F.max("effective_from").alias("last_day"), state.alias("state"),
    )
    runs = t.events.agg(F.to_date(F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))).alias("last_success"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))
    return catalog.crossJoin(runs)  # one row
