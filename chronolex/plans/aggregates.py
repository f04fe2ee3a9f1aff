"""Aggregations, windows, top-k and pagination over the corpus views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.functions import vectors as V
from chronolex.operators import evaluation, incremental, retrieval, selection, temporal
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query


@query("agg_latest_by_title", f"""WITH {VERSIONS}, latest AS (SELECT ministry, max(effective_from) AS d FROM versions WHERE {SEARCHABLE} AND price > 400000 GROUP BY ministry)
SELECT t.ministry, d AS latest, CASE WHEN d IS NULL THEN 'missing' ELSE 'ready' END AS state FROM (SELECT DISTINCT o_orderpriority AS ministry FROM orders UNION ALL SELECT '0-NONE') t LEFT JOIN latest l ON l.ministry = t.ministry""")
def agg_latest_by_title(t):
    latest = t.versions.where(temporal.searchable()).where("price > 400000").groupBy("ministry").agg(F.max("effective_from").alias("latest"))
    titles = t.orders.select(F.col("o_orderpriority").alias("ministry")).distinct().unionByName(t.spark.range(1).select(F.lit("0-NONE").alias("ministry")))
    return titles.join(latest, "ministry", "left").withColumn("state", F.when(F.col("latest").isNull(), "missing").otherwise("ready"))


@query("agg_versions_status", f"WITH {VERSIONS} SELECT lifecycle_state, count(*) AS n, max(effective_from) AS latest FROM versions GROUP BY 1")
def agg_versions_status(t):
    return t.versions.groupBy("lifecycle_state").agg(F.count("*").alias("n"), F.max("effective_from").alias("latest"))


@query("agg_last_sync", "SELECT max(CAST(ts AS TIMESTAMP)) AS last FROM events")
def agg_last_sync(t):
    return t.events.agg(F.max("ts").alias("last"))


@query("agg_source_snapshot", "SELECT c_mktsegment AS title, count(DISTINCT c_custkey) AS documents, count(DISTINCT o_orderkey) AS versions, count(DISTINCT l_partkey) AS parts, max(o_orderdate) AS last_order, max(l_shipdate) AS last_ship FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_source_snapshot(t):
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy(F.col("c_mktsegment").alias("title")).agg(
        F.count_distinct("c_custkey").alias("documents"), F.count_distinct("o_orderkey").alias("versions"), F.count_distinct("l_partkey").alias("parts"), F.max("o_orderdate").alias("last_order"), F.max("l_shipdate").alias("last_ship")
    )


@query("agg_environment", "SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders) AS versions, (SELECT count(*) FROM lineitem) AS provisions, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def agg_environment(t):
    for name in ("customer", "orders", "lineitem", "embeddings", "events"):
        getattr(t, name).createOrReplaceTempView(f"env_{name}")
    return t.spark.sql("SELECT (SELECT count(*) FROM env_customer) AS documents, (SELECT count(*) FROM env_orders) AS versions, (SELECT count(*) FROM env_lineitem) AS provisions, (SELECT count(*) FROM env_embeddings) AS embeddings, (SELECT count(*) FROM env_events WHERE event_type = 'error') AS errors")


@query("agg_temporal_population", f"""WITH {VERSIONS} SELECT lifecycle_state, min(effective_from) AS supported_from, count(*) AS n,
sha256('[' || string_agg('{{"id":' || version_id || ',"d":"' || effective_from || '"}}', ', ' ORDER BY version_id) || ']') AS fingerprint FROM versions WHERE {SEARCHABLE} GROUP BY lifecycle_state""")
def agg_temporal_population(t):
    rows = t.versions.where(temporal.searchable())
    line = F.to_json(F.struct(F.col("version_id").alias("id"), F.col("effective_from").cast("string").alias("d")))
    bounds = rows.groupBy("lifecycle_state").agg(F.min("effective_from").alias("supported_from"))
    return H.ordered_fingerprint(rows, "version_id", line, ["lifecycle_state"]).join(bounds, "lifecycle_state")


@query("agg_profile_coverage", "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS current, count(*) FILTER (len(embedding) <> 64) AS wrong_dims FROM embeddings GROUP BY label")
def agg_profile_coverage(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 3 == 0).alias("current"), F.count_if(F.size("embedding") != 64).alias("wrong_dims"))


@query("agg_publish_invariants", f"""WITH {VERSIONS} SELECT (SELECT count(*) FROM versions WHERE effective_to IS NOT NULL AND effective_to <= effective_from) AS invalid_periods, (SELECT count(*) FROM versions WHERE parser_version <> '3') AS parser_mismatches,
(SELECT count(*) FROM (SELECT document_id FROM versions WHERE effective_to IS NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_open, (SELECT count(*) FROM versions WHERE {SEARCHABLE}) AS eligible""")
def agg_publish_invariants(t):
    v = t.versions
    one = v.agg(
        F.count_if(F.col("effective_to") <= F.col("effective_from")).alias("invalid_periods"), F.count_if(F.col("parser_version") != "3").alias("parser_mismatches"), F.count_if(temporal.searchable()).alias("eligible")
    )
    open_ones = v.where("effective_to is null").groupBy("document_id").count().where("count > 1").agg(F.count("*").alias("duplicate_open"))
    return one.crossJoin(F.broadcast(open_ones))


@query("agg_migration_checks", "SELECT count(*) FILTER (o_orderdate IS NULL) AS null_starts, count(*) - count(DISTINCT (o_custkey, o_orderdate)) AS same_day FROM orders")
def agg_migration_checks(t):
    return t.orders.agg(F.count_if(F.col("o_orderdate").isNull()).alias("null_starts"), (F.count("*") - F.count_distinct("o_custkey", "o_orderdate")).alias("same_day"))


@query("agg_db_state", "SELECT count(*) FILTER (vec_id IS NULL) AS missing, count(*) FILTER (vec_id IS NOT NULL AND doc_id % 4 = 0) AS stale, count(vec_id) AS stored, max(length(text)) AS longest FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def agg_db_state(t):
    joined = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left")
    return joined.agg(F.count_if(F.col("vec_id").isNull()).alias("missing"), F.count_if(F.col("vec_id").isNotNull() & (F.col("doc_id") % 4 == 0)).alias("stale"), F.count("vec_id").alias("stored"), F.max(F.length("text")).cast("long").alias("longest"))


@query("agg_min_per_key", "SELECT user_id, event_type AS kind, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1, 2")
def agg_min_per_key(t):
    return incremental.earliest_deletions(t.events.select("user_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("day")), ["user_id", "kind"], "day")


@query("agg_matched_changed", "SELECT event_type AS kind, count(c_custkey) AS matched, count(*) FILTER (c_acctbal < value) AS changed FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def agg_matched_changed(t):
    joined = t.events.join(t.customer, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.groupBy(F.col("event_type").alias("kind")).agg(F.count("c_custkey").alias("matched"), F.count_if(F.col("c_acctbal") < F.col("value")).alias("changed"))


@query("agg_run_stats", """SELECT CAST(ts AS DATE) AS run, count(*) FILTER (event_type = 'view') AS ready, count(*) FILTER (event_type = 'click') AS unchanged, count(*) FILTER (event_type = 'error') AS failed,
CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'completed' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'failed' ELSE 'partial' END AS state FROM events GROUP BY 1""")
def agg_run_stats(t):
    failed = F.count_if(F.col("event_type") == "error")
    state = F.when(failed == 0, "completed").when(failed == F.count("*"), "failed").otherwise("partial")
    return t.events.groupBy(F.to_date("ts").alias("run")).agg(F.count_if(F.col("event_type") == "view").alias("ready"), F.count_if(F.col("event_type") == "click").alias("unchanged"), failed.alias("failed"), state.alias("state"))


@query("agg_conversation_refresh", "SELECT conv_id, count(*) AS turn_count, max(turn) AS last_turn, arg_max(left(text, 20), turn) AS last_text FROM conversations GROUP BY conv_id")
def agg_conversation_refresh(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turn_count"), F.max("turn").alias("last_turn"), F.max_by(F.substring("text", 1, 20), "turn").alias("last_text"))


@query("agg_retention_counts", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-05') AS deleted, count(DISTINCT user_id) FILTER (ts < TIMESTAMP '2024-01-05') AS parents FROM events")
def agg_retention_counts(t):
    old = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    return t.events.agg(F.count_if(old).alias("deleted"), F.count_distinct(F.when(old, F.col("user_id"))).alias("parents"))


@query("agg_bundle_counts", f"WITH {PROVISIONS} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS provisions, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM provisions GROUP BY source")
def agg_bundle_counts(t):
    return t.provisions.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("provisions"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


HITS = """ranked AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))), 6) AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ranked) WHERE rank <= 10)"""


def hits(t, k: int = 10, native: bool = False):
    v = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("embedding"))
    return retrieval.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k, native=native)


@query("topk_dense_exact", f"WITH {HITS} SELECT query_id, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM hits")
def topk_dense_exact(t):
    return hits(t)


@query("topk_dense_experiment", f"WITH {HITS.replace('rank <= 10', 'rank <= 11')} SELECT query_id, max(score) FILTER (rank = 10) = max(score) FILTER (rank = 11) AS tied, count(*) AS n FROM hits GROUP BY query_id")
def topk_dense_experiment(t):
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return hits(t, 11).groupBy("query_id").agg((at(10) == at(11)).alias("tied"), F.count("*").alias("n"))


@query("topk_candidate_limit", "SELECT i AS k, least(greatest(i * 5, 50), 200) AS n FROM generate_series(1, 60) AS g(i)")
def topk_candidate_limit(t):
    return t.spark.range(1, 61).select(F.col("id").alias("k"), retrieval.candidate_limit(F.col("id")).alias("n"))


@query("nearest_example", f"WITH {HITS} SELECT query_id, vec_id, score FROM hits WHERE rank = 1")
def nearest_example(t):
    return hits(t, 1).select("query_id", "vec_id", "score")


@query("agg_group_articles", f"WITH {HITS} SELECT query_id, label, CAST(min(rank) AS INTEGER) AS best_rank, max(score) AS best_score, count(*) AS n_hits, array_to_string(list_slice(list(vec_id ORDER BY rank), 1, 3), ',') AS first_hits FROM hits GROUP BY 1, 2")
def agg_group_articles(t):
    return selection.group_articles(hits(t), ["query_id"], "label").withColumn("first_hits", F.array_join("first_hits", ","))


@query("agg_article_contexts", f"WITH {HITS} SELECT query_id, label, arg_min(vec_id, rank) AS best, array_to_string(list(rank ORDER BY rank), ',') AS ranks FROM hits GROUP BY 1, 2")
def agg_article_contexts(t):
    return hits(t).groupBy("query_id", "label").agg(F.min_by("vec_id", "rank").alias("best"), F.array_join(F.array_sort(F.collect_list("rank")), ",").alias("ranks"))


@query("window_article_dedupe", f"WITH {HITS} SELECT query_id, vec_id, label, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM hits) WHERE n = 1")
def window_article_dedupe(t):
    rows = hits(t).select("*", F.col("label").alias("document_id"), F.concat(F.lit("a"), F.col("label"), F.lit("/x"), F.col("vec_id")).alias("path"))
    return temporal.first_per_article(rows, ["query_id"], [F.asc("rank")]).select("query_id", "vec_id", "label", "rank")


@query("limit_after_dedupe", f"WITH {HITS}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM hits) WHERE n = 1) SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS m FROM firsts) WHERE m <= 3")
def limit_after_dedupe(t):
    rows = hits(t).select("*", F.col("label").alias("document_id"), F.concat(F.lit("a"), F.col("label")).alias("path"))
    return retrieval.top(temporal.first_per_article(rows, ["query_id"], [F.asc("rank")]), ["query_id"], [F.asc("rank")], 3, "m").select("query_id", "vec_id")


@query("window_minmax_normalize", f"WITH {HITS} SELECT query_id, vec_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 - (rank - 1) / 9.0 END, 9) AS s FROM hits WINDOW w AS (PARTITION BY query_id)")
def window_minmax_normalize(t):
    return retrieval.min_max_by_query(hits(t)).select("query_id", "vec_id", F.round("normalised", 9).alias("s"))


@query("window_dense_position_rank", f"WITH {HITS} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score * (1 + label % 3) DESC, rank, vec_id) AS new_rank FROM hits")
def window_dense_position_rank(t):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("score") * (1 + F.col("label") % 3)), "rank", "vec_id")
    return hits(t).select("query_id", "vec_id", F.row_number().over(w).cast("long").alias("new_rank"))


@query("window_row_number_keyword", "SELECT p_partkey, CAST(rk AS INTEGER) AS rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY (CASE WHEN contains(lower(p_name), 'an') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END) DESC, p_partkey) AS rk FROM part) WHERE rk <= 50")
def window_row_number_keyword(t):
    score = F.when(F.contains(F.lower("p_name"), F.lit("an")), 2).otherwise(0) + F.when(F.contains(F.lower("p_type"), F.lit("steel")), 1).otherwise(0)
    ranked = t.part.select("p_partkey", score.alias("s")).orderBy(F.desc("s"), "p_partkey").limit(50)
    return ranked.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("s"), "p_partkey")).alias("rank"))


@query("window_row_number_semantic", f"WITH {HITS} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 5")
def window_row_number_semantic(t):
    return hits(t, 5).select("query_id", "vec_id", "rank")


@query("window_effective_periods", f"WITH {VERSIONS} SELECT version_id, effective_from, effective_to FROM versions")
def window_effective_periods(t):
    return t.versions.select("version_id", "effective_from", "effective_to")


@query("window_resolve_effective_to", f"WITH {VERSIONS} SELECT document_id, effective_from, count(*) AS n_versions FROM versions GROUP BY 1, 2 HAVING count(*) > 1")
def window_resolve_effective_to(t):
    return temporal.conflicting_starts(t.versions)


@query("window_close_open_versions", f"""WITH {VERSIONS}, s AS (SELECT o_custkey AS document_id, min(CAST(o_orderdate AS DATE)) AS new_start FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1)
SELECT version_id, CASE WHEN new_start IS NOT NULL AND effective_from < new_start AND (effective_to IS NULL OR effective_to > new_start) THEN new_start ELSE effective_to END AS effective_to FROM versions LEFT JOIN s USING (document_id)""")
def window_close_open_versions(t):
    return temporal.close_versions(t.versions, t.versions.where("version_id % 9 = 0")).select("version_id", "effective_to")


@query("window_turn_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM conversations WHERE role <> 'system'")
def window_turn_index(t):
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("turn_index"))


@query("window_backfill_turns", r"SELECT conv_id, left(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 120) AS title FROM conversations WHERE turn = 0")
def window_backfill_turns(t):
    from chronolex.functions.text import title_of

    return t.conversations.where("turn = 0").select("conv_id", title_of(F.col("text")).alias("title"))


@query("window_budget_prefix", "SELECT conv_id, turn, rolled_over FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running, sum(length(text)) OVER (PARTITION BY conv_id) > 1500 AS rolled_over FROM conversations) WHERE running <= 1500")
def window_budget_prefix(t):
    costs = t.conversations.select("conv_id", "turn", F.length("text").alias("cost"))
    return selection.newest_within(costs, "conv_id", "turn", "cost", 1500).select("conv_id", "turn", "rolled_over")


@query("window_group_islands", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = first_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events)")
def window_group_islands(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = t.events.withColumn("first_type", F.first("event_type").over(w))
    return first.select("user_id", "event_id", F.sum((F.col("event_type") == F.col("first_type")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


@query("window_forward_fill", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chapter FROM events")
def window_forward_fill(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("chapter"))


@query("window_keep_last_runs", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def window_keep_last_runs(t):
    return retrieval.top(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5, "n").select("user_id", "event_id")


_COSTS = f"{HITS}, costs AS (SELECT query_id, vec_id, n_chars, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits JOIN documents ON doc_id = vec_id)"


def budget_walk(budgets: str, most: int, exempt: bool, costs: str = _COSTS) -> str:
    """The walk over each query's hits, one step of a recursion by hit: CTEs of which ``walked`` has the last step by budget and query."""
    fits = "used + n_chars <= budget" + (" OR len(chosen) = 0" if exempt else "")
    take = f"len(chosen) < {most} AND used < budget AND ({fits})"
    return f"""{costs},
walk AS (SELECT DISTINCT query_id, budget, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS chosen, false AS skipped FROM costs, unnest({budgets}) AS b(budget)
  UNION ALL SELECT w.query_id, budget, c.n, CASE WHEN {take} THEN used + n_chars ELSE used END, CASE WHEN {take} THEN list_append(chosen, vec_id) ELSE chosen END, skipped OR (len(chosen) < {most} AND used < budget AND NOT ({fits}))
  FROM walk w JOIN costs c ON c.query_id = w.query_id AND c.n = w.n + 1),
walked AS (SELECT budget, query_id, used, chosen, skipped AS budget_exceeded FROM walk QUALIFY row_number() OVER (PARTITION BY budget, query_id ORDER BY n DESC) = 1)"""


@query("greedy_budget_select", f"WITH RECURSIVE {budget_walk('[6000]', 5, True)} SELECT query_id, used, array_to_string(chosen, ',') AS chosen, budget_exceeded FROM walked")
def greedy_budget_select(t):
    costs = hits(t).join(t.documents.select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    return selection.greedy_budget(costs, "query_id", "rank", "n_chars", "vec_id", 5, 6000).withColumn("chosen", F.array_join("chosen", ","))


@query("greedy_budget_variant_a", f"WITH RECURSIVE {budget_walk('[6000]', 5, False)} SELECT query_id, used, array_to_string(chosen, ',') AS chosen, budget_exceeded FROM walked")
def greedy_budget_variant_a(t):
    costs = hits(t).join(t.documents.select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    return selection.greedy_budget(costs, "query_id", "rank", "n_chars", "vec_id", 5, 6000, first_exempt=False).withColumn("chosen", F.array_join("chosen", ","))


@query("keyset_pagination", "SELECT event_id, user_id FROM events WHERE ts < (SELECT max(ts) FROM events) OR (ts = (SELECT max(ts) FROM events) AND event_id < 0) ORDER BY ts DESC, event_id DESC LIMIT 21")
def keyset_pagination(t):
    last = t.events.agg(F.max("ts").alias("m"))
    page = t.events.crossJoin(F.broadcast(last)).where("ts < m or (ts = m and event_id < 0)")
    return retrieval.keyset_page(page, "ts", "event_id", None, 20).select("event_id", "user_id")


@query("cursor_codec", "SELECT event_id, event_id AS id FROM events")
def cursor_codec(t):
    coded = t.events.select("event_id", retrieval.encode_cursor(F.col("ts").cast("string"), F.col("event_id")).alias("c"))
    return coded.select("event_id", retrieval.decode_cursor(F.col("c"))["id"].alias("id"))


@query("topk_stems", r"SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def topk_stems(t):
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(100)


@query("agg_doc_frequency", r"SELECT w, count(*) AS n FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark) GROUP BY w")
def agg_doc_frequency(t):
    words = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


@query("recent_history", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_history(t):
    return t.events.where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("agg_hit_rates", r"SELECT round(avg(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END), 9) AS rate, array_to_string(list_slice(list(item_id ORDER BY item_id) FILTER (contains(lower(text), 'the')), 1, 5), ',') AS samples FROM benchmark")
def agg_hit_rates(t):
    hit = F.contains(F.lower("text"), F.lit("the"))
    return t.benchmark.agg(F.round(F.avg(hit.cast("double")), 9).alias("rate"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(hit, F.col("item_id")))), 1, 5), ",").alias("samples"))


@query("agg_routing_report", "SELECT lang, round(avg(CASE WHEN quality <> toxic THEN 0.0 ELSE 1.0 END), 4) AS misclassified, round(avg(quality), 4) AS searched, round(avg(toxic), 4) AS blocked FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def agg_routing_report(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 4).alias("misclassified"), F.round(F.avg("quality"), 4).alias("searched"), F.round(F.avg("toxic"), 4).alias("blocked"))


@query("agg_citation_quality", "SELECT round(avg(CASE WHEN d.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS existing, round(avg(CASE WHEN contains(d.text, left(b.text, 40)) THEN 1.0 ELSE 0.0 END), 9) AS quoted FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 5")
def agg_citation_quality(t):
    """A quote is exact if the whole passage occurs; the SQL compares its first 40 characters."""
    docs = t.documents.select("doc_id", F.col("text").alias("d"))
    rows = t.benchmark.join(docs, F.col("doc_id") == F.col("item_id") * 5, "left")
    return rows.agg(F.round(F.avg(F.col("doc_id").isNotNull().cast("double")), 9).alias("existing"), F.round(F.avg(F.coalesce(F.contains("d", "text"), F.lit(False)).cast("double")), 9).alias("quoted"))


@query("agg_latency", """WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, count(*) FILTER (value < 1000) AS under_1s FROM events GROUP BY event_type)
SELECT event_type, n, v[1] AS min, v[(n + 1) // 2] AS p50, v[CAST(least(n, greatest(1, round_even(n * 0.95, 0))) AS BIGINT)] AS p95, v[n] AS max, under_1s FROM v""")
def agg_latency(t):
    return evaluation.latency_summary(t.events, ["event_type"], "value")


@query("percentile_type7", "SELECT event_type, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.5), 9) AS mid, round(quantile_cont(value, 0.975), 9) AS high FROM events GROUP BY 1")
def percentile_type7(t):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 9)
    return t.events.groupBy("event_type").agg(p(0.025).alias("low"), p(0.5).alias("mid"), p(0.975).alias("high"))


@query("agg_counters", "SELECT event_type, user_id % 3 AS tier, count(*) AS n FROM events GROUP BY 1, 2")
def agg_counters(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 3).alias("tier")).agg(F.count("*").alias("n"))


@query("agg_quota_conditional_inc", "SELECT user_id, CAST(ts AS DATE) AS day, least(count(*), 3) AS used, greatest(count(*) - 3, 0) AS rejected FROM events GROUP BY 1, 2")
def agg_quota_conditional_inc(t):
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    ranked = t.events.withColumn("n", F.row_number().over(day))
    return ranked.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("n") <= 3).alias("used"), F.count_if(F.col("n") > 3).alias("rejected"))


@query("agg_manual_review", f"WITH {HITS} SELECT count(DISTINCT query_id) FILTER (rank <= 1 AND label = query_id % 10) AS hit1, count(DISTINCT query_id) FILTER (rank <= 5 AND label = query_id % 10) AS hit5, count(*) FILTER (rank <= 5 AND label <> query_id % 10) AS irrelevant5 FROM hits")
def agg_manual_review(t):
    right = F.col("label") == F.col("query_id") % 10
    return hits(t).agg(
        F.count_distinct(F.when((F.col("rank") <= 1) & right, F.col("query_id"))).alias("hit1"), F.count_distinct(F.when((F.col("rank") <= 5) & right, F.col("query_id"))).alias("hit5"), F.count_if((F.col("rank") <= 5) & ~right).alias("irrelevant5")
    )


@query("agg_gold_audit", "SELECT reason, count(*) AS n_ids, array_to_string(list_slice(list(CAST(id AS VARCHAR) ORDER BY CAST(id AS VARCHAR)), 1, 10), ',') AS first_ids FROM (SELECT 'unlabelled' AS reason, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'no_vector', doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) GROUP BY reason")
def agg_gold_audit(t):
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    rules = {"unlabelled": ids(t.documents, "doc_id").join(ids(t.labels, "doc_id"), "id", "left_anti"), "no_vector": ids(t.labels, "doc_id").join(ids(t.embeddings, "vec_id"), "id", "left_anti")}
    return incremental.violations(rules).withColumn("first_ids", F.array_join("first_ids", ","))
