"""Loaders, reference lookup, whole-question runs, publishing workflows and report sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.functions import references as R
from chronolex.functions import vectors as V
from chronolex.operators import incremental, retrieval, selection, temporal
from chronolex.plans.aggregates import HITS, hits
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query
from chronolex.plans.joins import INCOMING, _incoming
from chronolex.plans.scans import AS_OF, as_of
from chronolex.plans.synchronisation import _folder
from chronolex.sources import bundle, parsers


@query("flagship_temporal_search", f"""WITH {VERSIONS}, valid AS (SELECT DISTINCT document_id FROM versions WHERE {AS_OF} AND {SEARCHABLE}), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, p.label, round(list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(p.e, p.e)), 6) AS score FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND p.vec_id IN (SELECT document_id FROM valid)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r WHERE rank <= 50)
SELECT query_id, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM a WHERE n = 1""")
def flagship_temporal_search(t):
    """Effective periods, the as-of and search filters, exact vector ranking, one hit for each article."""
    valid = t.versions.where(as_of()).where(temporal.searchable()).select(F.col("document_id").alias("vec_id"))
    v = t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("embedding"))
    ranked = retrieval.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.join(valid, "vec_id", "left_semi"), 50, most=v.count())
    rows = ranked.select("*", F.col("label").alias("document_id"), F.concat(F.lit("a"), F.col("label")).alias("path"))
    return temporal.first_per_article(rows, ["query_id"], [F.asc("rank")]).select("query_id", "vec_id", "label", "score", "rank")


@query("read_jsonl_strict", "SELECT item_id, text FROM benchmark")
def read_jsonl_strict(t):
    path = _folder(t, "jsonl")
    t.benchmark.write.json(path)
    return parsers.read_jsonl_strict(t.spark, path, "item_id long, text string")


@query("load_bundle", "SELECT count(*) AS n FROM nation")
def load_bundle(t):
    path = _folder(t, "bundle")
    bundle.write_bundle({"nation": t.nation, "region": t.region}, {"nation": "n_nationkey", "region": "r_regionkey"}, path)
    tables = bundle.load_bundle(t.spark, path, {"nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"})
    return tables["nation"].agg(F.count("*").alias("n"))


@query("load_file_corpus", "SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src3'")
def load_file_corpus(t):
    """A manifest of entries, abolished ones skipped, joined with the bodies that it names."""
    manifest = t.documents.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), F.when(F.col("source") == "src3", "abolished").otherwise("active").alias("state"))).alias("entry"))
    entries = manifest.select(F.from_json("entry", "file string, state string").alias("e")).select("e.*").where("state <> 'abolished'")
    bodies = t.documents.select(F.col("doc_id").cast("string").alias("file"), "doc_id", "text")
    return entries.join(bodies, "file").select("doc_id", F.sha2("text", 256).alias("h"))


@query("load_eval_cases", "SELECT count(*) AS n, count(DISTINCT item_id) = count(*) AS unique_ids, count(*) FILTER (trim(text) = '') AS blank FROM benchmark")
def load_eval_cases(t):
    return t.benchmark.agg(F.count("*").alias("n"), (F.count_distinct("item_id") == F.count("*")).alias("unique_ids"), F.count_if(F.trim("text") == "").alias("blank"))


@query("first_named_value", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def first_named_value(t):
    """The first value among several names, at the top or one level down."""
    wrapped = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"inner":'), "props", F.lit("}")))
    tried = [F.get_json_object(wrapped, p) for p in ("$.key", "$.k", "$.inner.key", "$.inner.k")]
    return t.events.select("event_id", F.coalesce(*tried).alias("v"))


@query("parent_by_short_line", f"WITH {PROVISIONS} SELECT c.provision_id, max(p.provision_id) AS parent FROM provisions c LEFT JOIN provisions p ON p.doc_id = c.doc_id AND p.ordinal < c.ordinal AND length(p.content) < 40 GROUP BY c.provision_id")
def parent_by_short_line(t):
    """The nearest enclosing node before each node in document order, by one window instead of a self join."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return t.provisions.select("provision_id", F.last(F.when(F.length("content") < 40, F.col("provision_id")), ignorenulls=True).over(w).alias("parent"))


@query("topk_overfetch_v2", "SELECT i AS k, least(i * 4, 100) AS n FROM generate_series(1, 60) AS g(i)")
def topk_overfetch_v2(t):
    return t.spark.range(1, 61).select(F.col("id").alias("k"), F.least(F.col("id") * 4, F.lit(100).cast("long")).alias("n"))


@query("greedy_budget_variant_b")
def greedy_budget_variant_b(t):
    """The fold of variant a over whole article texts instead of single hits."""
    # the length of ``subtree_text``: its lines and what joins them
    sizes = t.provisions.groupBy(F.col("doc_id").alias("vec_id")).agg((F.sum(F.length("content").cast("long") + 1) - 1).cast("int").alias("chars"))
    return selection.greedy_budget(hits(t).join(sizes, "vec_id"), "query_id", "rank", "chars", "vec_id", 3, 9000, first_exempt=False).withColumn("chosen", F.array_join("chosen", ","))


@query("publish_snapshot_id", f"WITH {VERSIONS} SELECT sha256('[' || string_agg(version_id || '|' || effective_from || '|' || coalesce(CAST(effective_to AS VARCHAR), '') || '|' || lifecycle_state || '|' || ministry, ', ' ORDER BY version_id) || ']') AS snapshot FROM versions")
def publish_snapshot_id(t):
    row = F.concat_ws("|", "version_id", "effective_from", F.coalesce(F.col("effective_to").cast("string"), F.lit("")), "lifecycle_state", "ministry")
    return H.ordered_fingerprint(t.versions, "version_id", row).select(F.col("fingerprint").alias("snapshot"))


@query("scope_hash", "SELECT item_id, sha256('{\"chars\":' || length(text) || ',\"scope\":\"in\"}') AS h FROM benchmark")
def scope_hash(t):
    return t.benchmark.select("item_id", F.sha2(H.canonical_json(scope=F.lit("in"), chars=F.length("text")), 256).alias("h"))


@query("observation_hash", f"WITH {HITS}, o AS (SELECT query_id, string_agg(vec_id, ',' ORDER BY rank) AS ids FROM hits GROUP BY query_id) SELECT sha256('[' || string_agg(query_id || ':' || ids, ', ' ORDER BY query_id) || ']') AS h FROM o")
def observation_hash(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]), ",")
    rows = hits(t).groupBy("query_id").agg(ids.alias("ids"))
    return H.ordered_fingerprint(rows, "query_id", F.concat_ws(":", "query_id", "ids")).select(F.col("fingerprint").alias("h"))


@query("generation_profile_sha", "SELECT n_nationkey, sha256('name=' || n_name || ';region=' || n_regionkey) AS h FROM nation")
def generation_profile_sha(t):
    parts = F.array_sort(F.array(F.concat(F.lit("region="), "n_regionkey"), F.concat(F.lit("name="), "n_name")))
    return t.nation.select("n_nationkey", F.sha2(F.array_join(parts, ";"), 256).alias("h"))


@query("provision_ref_lists", "SELECT o_orderkey, '제' || (o_orderkey % 40 + 1) || '조의2/항3,제' || (o_orderkey % 40 + 1) || '조의2/항5' AS paths FROM orders")
def provision_ref_lists(t):
    asked = F.concat(F.lit("법 제 "), F.col("o_orderkey") % 40 + 1, F.lit(" 조의 2 제삼항 및 제5항은?"))
    plain = t.orders.select("o_orderkey", R.with_arabic_numbers(asked).alias("q"))
    found = plain.select("o_orderkey", R.references(F.col("q")).alias("r"))
    return found.select("o_orderkey", F.array_join("r.paths", ",").alias("paths"))


@query("provision_ranges", "SELECT i AS k, CASE WHEN i > 30 THEN 'descending_range' WHEN 30 - i >= 20 THEN 'range_too_wide' END AS invalid, CASE WHEN i BETWEEN 11 AND 30 THEN 31 - i ELSE 0 END AS n FROM generate_series(1, 40) AS g(i)")
def provision_ranges(t):
    asked = t.spark.range(1, 41).select(F.col("id").alias("k"), F.concat(F.lit("제"), "id", F.lit("조부터 제30조까지")).alias("q"))
    found = asked.select("k", R.references(F.col("q")).alias("r"))
    return found.select("k", "r.invalid", F.size("r.paths").cast("long").alias("n"))


@query("storage_path_variants", "SELECT i AS k, '제1조/항' || i || '/호2/목가' AS plain, '제1조/항' || CASE WHEN i <= 20 THEN chr(CAST(9311 + i AS INTEGER)) ELSE CAST(i AS VARCHAR) END || '/호2./목가.' AS signed FROM generate_series(1, 25) AS g(i)")
def storage_path_variants(t):
    path = F.concat(F.lit("제1조/항"), "id", F.lit("/호2/목가"))
    both = t.spark.range(1, 26).select(F.col("id").alias("k"), path.alias("plain"), R.storage_variants(path).alias("v"))
    return both.select("k", "plain", F.element_at(F.filter("v", lambda x: x != F.col("plain")), 1).alias("signed"))


@query("korean_number", "SELECT * FROM (VALUES ('삼', '제3조'), ('십', '제10조'), ('이십오', '제25조'), ('백', '제100조'), ('삼백이십일', '제321조')) AS v(word, text)")
def korean_number(t):
    words = t.spark.createDataFrame([(w,) for w in ("삼", "십", "이십오", "백", "삼백이십일")], "word string")
    return words.select("word", R.with_arabic_numbers(F.concat(F.lit("제"), "word", F.lit("조"))).alias("text"))


@query("q_exp_search", f"WITH {HITS} SELECT query_id, label, max(score) AS best, count(*) AS n FROM hits GROUP BY 1, 2 HAVING count(*) >= 2")
def q_exp_search(t):
    return selection.group_articles(hits(t), ["query_id"], "label").where("n_hits >= 2").select("query_id", "label", F.col("best_score").alias("best"), F.col("n_hits").alias("n"))


@query("q_changes_api", f"WITH {INCOMING} SELECT s.doc_id FROM documents s JOIN incoming i USING (doc_id) WHERE s.text IS DISTINCT FROM i.text")
def q_changes_api(t):
    found = incremental.diff(t.documents, _incoming(t), "doc_id", ["text"], ["text"])
    return found.where("state = 'updated'").select("doc_id")


@query("m_preflight", "SELECT reason, count(*) AS n_ids FROM (SELECT 'not_in_corpus' AS reason, item_id AS id FROM benchmark WHERE item_id * 30 NOT IN (SELECT doc_id FROM documents) UNION SELECT 'short', item_id FROM benchmark WHERE length(text) < 150) GROUP BY reason")
def m_preflight(t):
    known = t.documents.select(F.col("doc_id").alias("d"))
    rules = {
        "not_in_corpus": t.benchmark.join(known, F.col("d") == F.col("item_id") * 30, "left_anti").select(F.col("item_id").alias("id")),
        "short": t.benchmark.where(F.length("text") < 150).select(F.col("item_id").alias("id")),
    }
    return incremental.violations(rules).select("reason", "n_ids")


@query("m_seal_review", "SELECT bool_and(quality IN (0, 1)) AS approved, sha256('[' || string_agg(doc_id || ':' || quality || ':' || toxic, ', ' ORDER BY doc_id) || ']') AS sealed FROM labels")
def m_seal_review(t):
    seal = H.ordered_fingerprint(t.labels, "doc_id", F.concat_ws(":", "doc_id", "quality", "toxic")).select(F.col("fingerprint").alias("sealed"))
    return t.labels.agg(F.bool_and(F.col("quality").isin(0, 1)).alias("approved")).crossJoin(F.broadcast(seal))


@query("m_question_approval", "SELECT item_id, sha256(text) AS confirmed, count(*) OVER (PARTITION BY sha256(text)) = 1 AS single FROM benchmark")
def m_question_approval(t):
    h = F.sha2("text", 256)
    return t.benchmark.select("item_id", h.alias("confirmed"), (F.count("*").over(Window.partitionBy(h)) == 1).alias("single"))


@query("m_grounding_replay", f"WITH {HITS}, f AS (SELECT query_id, list(vec_id) AS ids FROM hits GROUP BY query_id) SELECT query_id, list_contains(ids, (query_id * 13) % 500) AS again FROM f")
def m_grounding_replay(t):
    found = hits(t).groupBy("query_id").agg(F.collect_list(F.col("vec_id").cast("string")).alias("ids"))
    sections = F.array(F.struct(F.lit("c").alias("claim"), F.array(((F.col("query_id") * 13) % 500).cast("string")).alias("citation_ids")))
    return found.select("query_id", selection.structurally_grounded(sections, F.col("ids"), F.lit("answer")).alias("again"))


@query("upsert_text_merge", f"WITH {INCOMING} SELECT coalesce(i.doc_id, s.doc_id) AS doc_id, sha256(coalesce(i.text, s.text)) AS h, s.doc_id IS NOT NULL AND i.doc_id IS NOT NULL AND s.text IS DISTINCT FROM i.text AS invalidated FROM documents s FULL JOIN incoming i ON s.doc_id = i.doc_id")
def upsert_text_merge(t):
    """Stored and incoming rows merged into a new table; a changed text invalidates what was derived from it."""
    states = incremental.diff(t.documents, _incoming(t), "doc_id", ["text"], ["text"]).select("doc_id", "stale_embedding")
    rows = t.documents.select("doc_id", F.col("text").alias("s")).join(_incoming(t).select("doc_id", F.col("text").alias("i")), "doc_id", "full")
    return rows.join(states, "doc_id").select("doc_id", F.sha2(F.coalesce("i", "s"), 256).alias("h"), F.col("stale_embedding").alias("invalidated"))


@query("preview_open_versions", f"WITH {VERSIONS} SELECT count(*) FILTER (version_id % 9 = 0) AS incoming, count(*) FILTER (effective_to IS NULL AND document_id IN (SELECT document_id FROM versions WHERE version_id % 9 = 0)) AS would_close FROM versions")
def preview_open_versions(t):
    touched = t.versions.where("version_id % 9 = 0").select("document_id", F.lit(True).alias("touched")).distinct()
    rows = t.versions.join(touched, "document_id", "left")
    return rows.agg(F.count_if(F.col("version_id") % 9 == 0).alias("incoming"), F.count_if(F.col("effective_to").isNull() & F.col("touched").isNotNull()).alias("would_close"))


@query("inc_required_embeddings", f"WITH {INCOMING} SELECT doc_id FROM incoming WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def inc_required_embeddings(t):
    held = t.documents.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("h")).distinct()
    return _incoming(t).select("doc_id", F.sha2("text", 256).alias("h")).join(held, "h", "left_anti").select("doc_id")


@query("pending_lengths", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first FROM documents WHERE doc_id >= 100")
def pending_lengths(t):
    """Vectors for what the cache lacks, made in Arrow batches by a pluggable function, beside what it holds."""
    import pyarrow as pa

    cached = t.documents.where("doc_id < 100").select("doc_id")
    pending = t.documents.join(cached, "doc_id", "left_anti").select("doc_id", "text")

    def embed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(len(x or "")) for x in b.column(1).to_pylist()])], names=["doc_id", "first"])

    return pending.mapInArrow(embed, "doc_id long, first double")


@query("cache_completeness", "SELECT count(*) FILTER (vec_id IS NULL) = 0 AS complete, count(*) FILTER (vec_id IS NOT NULL) AS loaded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def cache_completeness(t):
    joined = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left")
    return joined.agg((F.count_if(F.col("vec_id").isNull()) == 0).alias("complete"), F.count("vec_id").alias("loaded"))


@query("inc_promote_profile", "SELECT label AS profile, count(*) >= 50 AND bool_and(len(embedding) = 64) AS active FROM embeddings GROUP BY label")
def inc_promote_profile(t):
    return t.embeddings.groupBy(F.col("label").alias("profile")).agg(((F.count("*") >= 50) & F.bool_and(F.size("embedding") == 64)).alias("active"))


@query("inc_sync_history", f"WITH {VERSIONS} SELECT document_id, count(DISTINCT effective_from) AS periods, count(*) FILTER (effective_to IS NULL) AS open_versions FROM versions GROUP BY 1")
def inc_sync_history(t):
    return t.versions.groupBy("document_id").agg(F.count_distinct("effective_from").alias("periods"), F.count_if(F.col("effective_to").isNull()).alias("open_versions"))


@query("inc_prepare_bundle", "SELECT count(*) AS n, count(DISTINCT text) AS texts, true AS base_unchanged FROM documents")
def inc_prepare_bundle(t):
    """The whole body is written between two fingerprints of the base, each run by itself; a change in between stops the run."""
    mark = lambda: H.merkle_fingerprint(t.documents, "doc_id", F.sha2("text", 256)).first()
    before, path = mark(), _folder(t, "prepared")
    t.documents.write.parquet(path)
    if mark() != before:
        raise RuntimeError("the base changed while the bundle was prepared")
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")).withColumn("base_unchanged", F.lit(True))


@query("sink_no_overwrite", "SELECT 5 AS n, true AS refused")
def sink_no_overwrite(t):
    root = _folder(t, "once")
    incremental.publish(t.region, root, "one")
    try:
        incremental.publish(t.region, root, "one")
        refused = False
    except Exception as e:
        refused = "ALREADY_EXISTS" in str(e).upper().replace(" ", "_")
        if not refused:
            raise
    return t.spark.read.parquet(f"{root}/snapshot=one").agg(F.count("*").cast("int").alias("n")).withColumn("refused", F.lit(refused))


@query("sink_checklist_csv", "SELECT conv_id, turn, '\"' || replace(role, '\"', '\"\"') || '\",' || length(text) AS line FROM conversations")
def sink_checklist_csv(t):
    line = F.concat(F.lit('"'), F.replace("role", F.lit('"'), F.lit('""')), F.lit('",'), F.length("text"))
    return t.conversations.select("conv_id", "turn", line.alias("line"))


@query("sink_reports_md", "SELECT event_type, '| ' || event_type || ' | ' || count(*) || ' | ' || count(DISTINCT user_id) || ' |' AS row FROM events GROUP BY event_type")
def sink_reports_md(t):
    grouped = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return grouped.select("event_type", F.concat(F.lit("| "), "event_type", F.lit(" | "), "n", F.lit(" | "), "u", F.lit(" |")).alias("row"))


@query("agg_eval_search", f"WITH {HITS} SELECT round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END), 9) AS recall3, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0.0 END), 9) AS recall10, round(avg(coalesce(1.0 / f, 0)), 9) AS mrr FROM (SELECT query_id, min(rank) FILTER (label = query_id % 10) AS f FROM hits GROUP BY query_id)")
def agg_eval_search(t):
    first = hits(t).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("query_id") % 10, F.col("rank"))).alias("f"))
    rate = lambda k: F.round(F.avg(F.coalesce((F.col("f") <= k).cast("double"), F.lit(0.0))), 9)
    return first.agg(rate(3).alias("recall3"), rate(10).alias("recall10"), F.round(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))), 9).alias("mrr"))
