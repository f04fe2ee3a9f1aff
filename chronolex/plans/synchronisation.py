"""Parsing, incremental synchronisation, identities and keyed state over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.functions import text as X
from chronolex.operators import activation, incremental, temporal
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query
from chronolex.plans.joins import INCOMING, _incoming
from chronolex.sources import bundle, parsers
from chronolex.sources.shared import new_folder
from chronolex.streaming import events as S

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _folder(t, name: str) -> str:
    return new_folder(t.spark, name)


def _bodies(t, xml: bool = False):
    """Each order as a document body: an article with its line items as paragraphs, the same tree in either form."""
    line = F.struct(F.col("l_linenumber").cast("string").alias("no"), F.concat(F.lit("part "), "l_partkey", F.lit(" of "), "l_suppkey").alias("text"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("paragraphs"))
    rows = t.orders.join(lines, F.col("id") == F.col("o_orderkey"))
    article = F.struct(F.lit("1").alias("number"), F.lit("article").alias("kind"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("order "), "o_orderkey").alias("text"), "paragraphs")
    body = F.struct(
        F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").cast("string").alias("mst"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyyMMdd").alias("effective_from"),
        F.array(article).alias("articles"),
    )
    return rows.select("id", (F.to_xml(body, {"rowTag": "document"}) if xml else F.to_json(body)).alias("body"))


_TREE = """SELECT o_orderkey AS id, 'a1' AS path, 'order ' || o_orderkey AS content FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'a1/p' || l_linenumber, min('part ' || l_partkey || ' of ' || l_suppkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber"""


def _flat(t, xml: bool):
    parsed = _bodies(t, xml).select("id", parsers.parse_body(F.col("body")).alias("r")).select("id", "r.document")
    return parsers.flatten_tree(parsed).select("id", "path", "content")


@query("read_compact_json", _TREE)
def read_compact_json(t):
    return _flat(t, xml=False)


@query("read_compact_xml", _TREE)
def read_compact_xml(t):
    return _flat(t, xml=True)


@query("compact_tree_sizes", f"SELECT id, count(*) AS n, count(*) AS last FROM ({_TREE}) GROUP BY id")
def compact_tree_sizes(t):
    parsed = _bodies(t).select("id", parsers.parse_body(F.col("body")).alias("r")).select("id", "r.document")
    return parsers.flatten_tree(parsed).groupBy("id").agg(F.count("*").alias("n"), F.max("ordinal").cast("long").alias("last"))


@query("json_then_xml_fallback", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'not JSON, read as XML' ELSE 'neither JSON nor XML' END AS reason FROM pages""")
def json_then_xml_fallback(t):
    m = F.col("page_id") % 3
    body = F.when(m == 0, F.to_json(F.struct(F.col("url").alias("title")))).when(m == 1, F.lit("<document><title>x</title></document>")).otherwise(F.lit("{broken"))
    return t.pages.select("page_id", parsers.parse_body(body)["reason"].alias("reason"))


@query("read_search_results_json", "SELECT n_regionkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS place, n_name AS title, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS effective_from FROM nation")
def read_search_results_json(t):
    entry = F.struct("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("title"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy.MM.dd").alias("effective_from"))
    listing = t.nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("results"))).alias("body"))
    return parsers.search_listing(listing, "id", "body").select("id", "place", "title", "effective_from")


@query("read_history", "SELECT o_custkey AS mst, CAST(o_orderdate AS DATE) AS effective_from, max(o_orderkey) AS entry FROM orders GROUP BY 1, 2")
def read_history(t):
    entries = t.orders.select(F.col("o_custkey").alias("mst"), F.to_date("o_orderdate").alias("effective_from"), F.col("o_orderkey").alias("entry"))
    return parsers.version_history(entries, "entry")


@query("read_article_history_msts", "SELECT DISTINCT user_id AS mst FROM events WHERE event_type = 'purchase'")
def read_article_history_msts(t):
    return t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("mst")).distinct()


@query("read_deletions", "SELECT DISTINCT user_id AS mst, CAST(ts AS DATE) AS deleted_on FROM events WHERE event_type = 'error'")
def read_deletions(t):
    pages = t.events.select(F.col("user_id").alias("mst"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyyMMdd").alias("deleted_on"))
    return parsers.deletion_feed(pages, "error")


@query("count_deletion_pages", "SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) AS n, count(DISTINCT event_id // 100) AS pages FROM events WHERE event_type = 'error'")
def count_deletion_pages(t):
    pages = t.events.where("event_type = 'error'").withColumn("page", F.floor(F.col("event_id") / 100))
    return pages.agg(F.count_distinct("user_id", F.to_date("ts")).alias("n"), F.count_distinct("page").alias("pages"))


@query("read_vector_cache", "SELECT vec_id, label + 1 AS label FROM embeddings")
def read_vector_cache(t):
    path = _folder(t, "cache")
    both = t.embeddings.select("vec_id", "label").unionByName(t.embeddings.select("vec_id", (F.col("label") + 1).alias("label")))
    lines = both.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "vec_id"))).alias("r")).select(F.concat(F.array_join(F.transform("r", lambda x: F.to_json(x)), "\n"), F.lit('\n{"label":1,"vec')).alias("value"))
    lines.write.text(path)
    return parsers.read_vector_cache(t.spark, path, "vec_id long, label int", "vec_id").select("vec_id", "label")


@query("sink_bundle", "SELECT o_orderkey, o_orderstatus FROM orders")
def sink_bundle(t):
    path = _folder(t, "bundle")
    bundle.write_bundle({"orders": t.orders.select("o_orderkey", "o_orderstatus")}, {"orders": "o_orderkey"}, path)
    return bundle.load_bundle(t.spark, path, {"orders": "o_orderkey long, o_orderstatus string"})["orders"]


@query("regroup_repeated_labels", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS group_no FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)")
def regroup_repeated_labels(t):
    return parsers.regroup_flat(t.events, ["user_id"], "event_id", "event_type").select("user_id", "event_id", F.col("group_no").cast("long").alias("group_no"))


@query("two_numbered_sections", "SELECT doc_id, CAST(2 AS BIGINT) AS n FROM documents")
def two_numbered_sections(t):
    made = F.concat(F.lit("Scope "), F.lit("1.1 first, from 2.5-3.5 on. "), F.lit("1.2 second on 2024.1.2 of "), F.regexp_replace("text", r"\d", ""))
    return t.documents.select("doc_id", F.size(parsers.numbered_sections(made)).cast("long").alias("n"))


@query("admin_rule_paragraphs", f"WITH {PROVISIONS} SELECT doc_id, ordinal, 'body/p' || (ordinal + 1) AS path FROM provisions")
def admin_rule_paragraphs(t):
    return parsers.rule_paragraphs(t.provisions.select("doc_id", "ordinal", "content"), "doc_id", "ordinal", "content").select("doc_id", "ordinal", "path")


@query("text_fixture_source", f"WITH {PROVISIONS}, m AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^(The|An|Un|Der|El)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS block FROM provisions) SELECT doc_id, CAST(block AS BIGINT) AS block, sha256(string_agg(content, chr(10) ORDER BY ordinal)) AS h, count(*) AS n_lines FROM m GROUP BY ALL")
def text_fixture_source(t):
    blocks = parsers.text_blocks(t.provisions, "doc_id", "ordinal", "content", "^(The|An|Un|Der|El)")
    return blocks.select("doc_id", F.col("block").cast("long").alias("block"), F.sha2("text", 256).alias("h"), "n_lines")


@query("chapter_assignment", f"WITH {PROVISIONS} SELECT provision_id, last_value(CASE WHEN length(content) < 30 THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS chapter FROM provisions")
def chapter_assignment(t):
    return parsers.assign_chapters(t.provisions, "doc_id", "ordinal", F.when(F.length("content") < 30, F.col("content"))).select("provision_id", "chapter")


@query("article_range_select", "SELECT i AS part FROM generate_series(0, 400) AS g(i) WHERE i NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def article_range_select(t):
    return parsers.missing_in_range(t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("part")), "part", 0, 400)


@query("canonical_provision_id")
def canonical_provision_id(t):
    name = H.canonical_json(effective_from=F.lit("2024-01-01"), mst=F.col("doc_id").cast("string"), path=F.col("path"), source_id=F.col("source"), source_kind=F.lit("law"))
    return t.provisions.select("provision_id", H.uuid5(NAMESPACE, name).alias("id"))


@query("fingerprint_population", f"WITH {VERSIONS} SELECT count(*) AS n, sha256('[' || string_agg('{{\"id\":' || version_id || ',\"state\":\"' || lifecycle_state || '\"}}', ', ' ORDER BY version_id) || ']') AS fingerprint FROM versions WHERE {SEARCHABLE}")
def fingerprint_population(t):
    rows = t.versions.where(temporal.searchable())
    return H.ordered_fingerprint(rows, "version_id", F.to_json(F.struct(F.col("version_id").alias("id"), F.col("lifecycle_state").alias("state"))))


@query("merkle_fingerprint")
def merkle_fingerprint(t):
    return H.merkle_fingerprint(t.versions, "version_id", F.col("lifecycle_state"))


@query("snapshot_id", f"WITH {VERSIONS}, p AS (SELECT lifecycle_state, count(*) AS n FROM versions GROUP BY 1) SELECT sha256('[' || string_agg('[\"' || lifecycle_state || '\",' || n || ']', ',' ORDER BY lifecycle_state) || ']') AS snapshot FROM p")
def snapshot_id(t):
    p = t.versions.groupBy("lifecycle_state").count()
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("lifecycle_state", "count"))), lambda x: F.concat(F.lit('["'), x["lifecycle_state"], F.lit('",'), x["count"], F.lit("]")))
    return p.agg(F.sha2(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")), 256).alias("snapshot"))


@query("gold_population_fingerprints", f"WITH {VERSIONS}, d AS (SELECT DATE '1996-01-01' + CAST(i * 300 AS INTEGER) AS day FROM generate_series(0, 4) AS g(i)) SELECT day, count(*) AS n, sha256('[' || string_agg(CAST(version_id AS VARCHAR), ', ' ORDER BY version_id) || ']') AS fingerprint FROM d JOIN versions ON effective_from <= day AND (effective_to IS NULL OR effective_to > day) GROUP BY day")
def gold_population_fingerprints(t):
    days = t.spark.range(5).select(F.expr("date_add(date'1996-01-01', cast(id * 300 as int))").alias("day"))
    rows = t.versions.join(F.broadcast(days), temporal.valid_on(F.col("day")))
    return H.ordered_fingerprint(rows, "version_id", F.col("version_id").cast("string"), ["day"])


@query("canonical_json_sha", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS h FROM nation")
def canonical_json_sha(t):
    return t.nation.select("n_nationkey", F.sha2(H.canonical_json(region=F.col("n_regionkey"), name=F.col("n_name")), 256).alias("h"))


@query("question_set_hash", "SELECT sha256('[' || string_agg(sha256(text), ', ' ORDER BY item_id) || ']') AS h FROM benchmark")
def question_set_hash(t):
    return H.ordered_fingerprint(t.benchmark, "item_id", F.sha2("text", 256)).select(F.col("fingerprint").alias("h"))


@query("id_set_hash", "SELECT label, sha256('[' || string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) || ']') AS h FROM embeddings GROUP BY label")
def id_set_hash(t):
    return t.embeddings.groupBy("label").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("vec_id"))), 256).alias("h"))


@query("embedding_sha")
def embedding_sha(t):
    return t.embeddings.select("vec_id", H.vector_sha256(F.col("embedding").cast("array<double>")).alias("h"))


@query("cache_key", "SELECT item_id, sha256(text || '|profile|' || item_id) AS key FROM benchmark")
def cache_key(t):
    return t.benchmark.select("item_id", F.sha2(F.concat("text", F.lit("|profile|"), "item_id"), 256).alias("key"))


@query("hash_split", "SELECT doc_id, CAST(list_sum(list_transform(string_split(sha256(CAST(doc_id AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 AS BIGINT) AS split FROM documents")
def hash_split(t):
    return t.documents.select("doc_id", H.modulo_split(F.col("doc_id").cast("string"), 5).alias("split"))


@query("bootstrap_draw", "SELECT i, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(substring(sha256('seed:' || i), 1, 16), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS HUGEINT))), lambda a, c: a * 16 + c) % 37 AS BIGINT) AS draw FROM generate_series(0, 499) AS g(i)")
def bootstrap_draw(t):
    return t.spark.range(500).select(F.col("id").alias("i"), H.draw(F.concat(F.lit("seed:"), "id"), F.lit(37)).alias("draw"))


@query("daily_subject_hash")
def daily_subject_hash(t):
    return t.events.select("event_id", H.daily_subject("secret")(F.to_date("ts").cast("string"), F.col("user_id").cast("string")).alias("subject"))


@query("canonical_ip")
def canonical_ip(t):
    address = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("::ffff:10.0.0."), F.col("user_id") % 250)).when(F.col("user_id") % 3 == 1, F.lit("2001:0db8:0000::0001")).otherwise(F.lit("not an address"))
    return t.events.select("event_id", H.canonical_ip(address).alias("ip"))


@query("raw_object_path", "SELECT doc_id, 'raw/' || left(sha256(text), 2) || '/' || sha256(text) || '.txt' AS path FROM documents")
def raw_object_path(t):
    h = F.sha2("text", 256)
    return t.documents.select("doc_id", F.concat(F.lit("raw/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit(".txt")).alias("path"))


@query("inc_provision_sync", f"""WITH {INCOMING} SELECT state, count(*) AS n, count(*) FILTER (stale) AS n_stale, count(*) FILTER (state IN ('updated', 'removed')) AS n_derived FROM (
SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN i.doc_id IS NULL THEN 'removed' WHEN s.text IS DISTINCT FROM i.text OR s.source IS DISTINCT FROM i.source THEN 'updated' ELSE 'unchanged' END AS state,
s.doc_id IS NOT NULL AND i.doc_id IS NOT NULL AND s.text IS DISTINCT FROM i.text AS stale FROM documents s FULL JOIN incoming i ON s.doc_id = i.doc_id) GROUP BY state""")
def inc_provision_sync(t):
    found = incremental.diff(t.documents, _incoming(t), "doc_id", ["text", "source"], ["text"])
    return found.groupBy("state").agg(F.count("*").alias("n"), F.count_if("stale_embedding").alias("n_stale"), F.count_if("stale_derived").alias("n_derived"))


#: What is compared between two states of a version, in this order.
VERSION_FIELDS = (
    "promulgation_number", "promulgated_on", "effective_from", "effective_to", "ministry", "source_url", "raw_format", "raw_sha256", "raw_storage_path", "parser_schema_version", "fallback_reason", "lifecycle_state",
    "source_record_state", "source_deleted_on", "has_supplementary_provisions",
)


def _version_states(t, incoming: bool):
    """Orders as version records; in the incoming ones field i differs where the order's number is divisible by i + 7."""
    day, key, text = F.to_date("o_orderdate"), F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    sha = F.sha2(text, 256)
    fields = [
        text, day, day, F.lit(None).cast("date"), F.col("o_orderpriority"), F.concat(F.lit("/law/"), text), F.lit("json"), sha, F.concat(F.lit("raw/"), sha), F.lit("3"), F.lit(None).cast("string"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("scheduled"), F.lit("available"), F.lit(None).cast("date"), F.lit(False),
    ]
    if incoming:
        other = {"date": F.lit("2030-01-01").cast("date"), "string": F.lit("other"), "boolean": F.lit(True)}
        kinds = ["date" if n.endswith("_on") or n.startswith("effective") else "boolean" if n.startswith("has_") else "string" for n in VERSION_FIELDS]
        fields = [F.when(key % (i + 7) == 0, other[kind]).otherwise(f) for i, (f, kind) in enumerate(zip(fields, kinds, strict=True))]
    return t.orders.select(key.alias("version_id"), *[f.alias(n) for f, n in zip(fields, VERSION_FIELDS, strict=True)])


@query("inc_version_changed", "SELECT * FROM (SELECT o_orderkey AS version_id, concat_ws(',', " + ", ".join(f"CASE WHEN o_orderkey % {i + 7} = 0 THEN '{n}' END" for i, n in enumerate(VERSION_FIELDS)) + ") AS changed FROM orders) WHERE changed <> ''")
def inc_version_changed(t):
    found = incremental.diff(_version_states(t, False), _version_states(t, True), "version_id", list(VERSION_FIELDS), ["raw_sha256"]).where("state = 'updated'")
    return found.select("version_id", F.array_join("changed", ",").alias("changed"))


@query("inc_has_changes", f"WITH {INCOMING} SELECT (SELECT count(*) FROM incoming i LEFT JOIN documents s USING (doc_id) WHERE s.text IS DISTINCT FROM i.text) > 0 AS changed")
def inc_has_changes(t):
    found = incremental.diff(t.documents, _incoming(t), "doc_id", ["text"], ["text"])
    return found.agg(F.coalesce(F.bool_or(F.col("state") != "unchanged"), F.lit(False)).alias("changed"))


@query("inc_source_deletions", "SELECT o_orderkey AS version_id, CASE WHEN d IS NOT NULL THEN 'deleted' ELSE 'available' END AS record_state, d AS deleted_on FROM orders LEFT JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = o_orderkey")
def inc_source_deletions(t):
    versions = t.orders.select(F.col("o_orderkey").alias("version_id"), F.lit("available").alias("record_state"), F.lit(None).cast("date").alias("deleted_on"))
    feed = t.events.where("event_type = 'error'").select(F.col("user_id").alias("version_id"), F.to_date("ts").alias("deleted_on"))
    once = incremental.quarantine(versions, feed, "version_id", "deleted_on")
    return incremental.quarantine(once, feed, "version_id", "deleted_on").select("version_id", "record_state", "deleted_on")


@query("inc_embedding_pending", "SELECT CASE WHEN vec_id IS NULL THEN 'missing' WHEN vec_id % 5 = 0 THEN 'stale' ELSE 'current' END AS state, count(*) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1")
def inc_embedding_pending(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    held = t.embeddings.join(rows, F.col("vec_id") == F.col("doc_id")).select("doc_id", F.when(F.col("vec_id") % 5 == 0, "old").otherwise(F.col("h")).alias("h"))
    return incremental.pending_embeddings(rows, held, "doc_id", "h").groupBy("state").agg(F.count("*").alias("n"))


@query("inc_vector_reuse_by_hash", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), e AS (SELECT h, min(doc_id) AS from_key FROM h WHERE doc_id < 500 GROUP BY h) SELECT doc_id, from_key FROM h JOIN e USING (h) WHERE doc_id >= 500")
def inc_vector_reuse_by_hash(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.array(F.col("n_chars")).alias("v"))
    return incremental.reuse_by_hash(rows.where("doc_id >= 500").drop("v"), rows.where("doc_id < 500"), "doc_id", "h", "v").select("doc_id", "from_key")


@query("inc_v2_ingest", f"WITH {INCOMING} SELECT doc_id, sha256(text) AS h FROM incoming UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM incoming)")
def inc_v2_ingest(t):
    """Changed rows are replaced and vanished ids stay, as this ingestion never removes them."""
    incoming = _incoming(t).select("doc_id", "text")
    kept = t.documents.select("doc_id", "text").join(incoming, "doc_id", "left_anti")
    return kept.unionByName(incoming).select("doc_id", F.sha2("text", 256).alias("h"))


@query("inc_merge_current", "SELECT o_custkey AS document_id, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS version_id FROM orders GROUP BY 1, 2")
def inc_merge_current(t):
    rows = t.orders.select(F.col("o_custkey").alias("document_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("version_id"))
    return incremental.last_wins(rows, ["document_id", "day"], [F.desc("version_id")])


@query("publish_pointer", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def publish_pointer(t):
    """Publish a snapshot, move the pointer, and read what is active."""
    root = _folder(t, "published")
    incremental.publish(t.orders.select("o_orderkey", "o_orderstatus"), root, "s1")
    incremental.point_to(t.spark, root, "s1")
    return incremental.active(t.spark, root).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _activation_input(t):
    """Orders as versions and their lines as articles with a paragraph each; the order's number plants one fault in most of them."""
    k = F.col("o_orderkey") % 29
    at = lambda i, bad, good: F.when(k == i, bad).otherwise(good)
    none = F.lit(None).cast("string")
    body = F.concat(F.lit('{"id":'), "o_orderkey", at(20, F.lit(',"폐지일자":"20200101"'), F.lit("")), at(21, F.lit(',"삭제여부":"Y"'), F.lit("")), at(22, F.lit(',"부칙":{"부칙내용":"1"}'), F.lit("")), at(23, F.lit(',"폐지여부":"N"'), F.lit("")), F.lit("}"))
    day = F.to_date("o_orderdate")
    versions = t.orders.select(
        F.col("o_orderkey").alias("version_id"), at(1, F.lit(" "), F.lit("title")).alias("title"), at(2, F.lit(""), F.col("o_custkey").cast("string")).alias("source_id"), at(3, none, F.col("o_orderkey").cast("string")).alias("mst"),
        at(4, F.lit(None).cast("date"), day).alias("effective_from"), at(5, F.lit("2"), F.lit("3")).alias("parser_version"), F.lit("law").alias("source_kind"), at(16, F.lit("xml"), F.lit("json")).alias("raw_format"),
        F.lit("JSON").alias("wire_format"), at(17, F.lit("0"), F.sha2(body, 256)).alias("raw_sha256"), body.alias("body"), k.alias("k"),
    )
    lines = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("n")).distinct().join(versions.where("k <> 6").select("version_id", "k", "effective_from", "mst", "source_id"), "version_id")
    root = F.concat(F.when((F.col("k") == 10) & (F.col("n") == 1), "부록").otherwise("제"), "n", F.lit("조"))
    on = lambda i: (F.col("k") == i) & (F.col("n") == 1)
    article = F.struct(root.alias("path"), none.alias("parent_path"), F.when(on(8), " ").when(on(12), "제1장 총칙").otherwise("text").alias("content"))
    parent = F.when(on(9), "제99조").when(on(11), none).when(on(13), "제2조").otherwise(root)
    paragraph = F.struct(F.concat(root, F.lit("/항1")).alias("path"), parent.alias("parent_path"), F.lit("text").alias("content"))
    nodes = F.when(on(7), F.array(article, article, paragraph)).when(on(14), F.array(F.struct(F.concat(root, F.lit("/항1")).alias("path"), F.concat(root, F.lit("/항1")).alias("parent_path"), F.lit("text").alias("content")))).otherwise(F.array(article, paragraph))
    flat = lines.select("version_id", "k", "n", "effective_from", "mst", "source_id", F.inline(nodes))
    ident = activation.canonical_id(NAMESPACE, F.col("effective_from"), F.col("mst"), F.col("path"), F.col("source_id"), F.lit("law"))
    return versions.drop("k"), flat.select("version_id", "path", "parent_path", "content", F.when(on(15), "other").otherwise(ident).alias("provision_id"))


_FAULTS = ", ".join(f"'{r}'" for r in activation.RULES)


@query("inc_activation_rules", f"""WITH l AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS first, bool_or(l_linenumber = 2) AS second FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 29 AS k, CASE WHEN k BETWEEN 1 AND 5 THEN [{_FAULTS}][k] WHEN l_orderkey IS NULL OR k = 6 THEN 'no_provisions' WHEN k IN (16, 17) THEN [{_FAULTS}][k]
  WHEN k BETWEEN 7 AND 15 AND first THEN CASE WHEN k = 13 AND NOT second THEN 'parent_absent' ELSE [{_FAULTS}][k] END END AS problem FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT version_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN k = 20 THEN 'abolished' WHEN day > DATE '1996-06-30' THEN 'scheduled' ELSE 'active' END END AS lifecycle_state,
  CASE WHEN problem IS NULL THEN CASE WHEN k = 21 THEN 'deleted' ELSE 'available' END END AS record_state, CASE WHEN problem IS NULL THEN k = 22 END AS has_supplementary FROM x""")
def inc_activation_rules(t):
    versions, provisions = _activation_input(t)
    return activation.activation(versions, provisions, F.lit("1996-06-30").cast("date"), "3", NAMESPACE)


@query("stream_tumbling", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    out = S.run_to_table(S.tumbling(S.read_events(t.spark, f"{t.sf_dir}/events.parquet")), "update")
    return S.latest(out, ["w", "event_type"]).select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sliding", "SELECT day, count(*) AS n FROM (SELECT unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS day FROM events) GROUP BY day")
def stream_sliding(t):
    out = S.run_to_table(S.sliding(S.read_events(t.spark, f"{t.sf_dir}/events.parquet")), "update")
    return S.latest(out, ["w"]).select(F.to_date("w.start").alias("day"), "n")


@query("stream_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(CAST(ts AS TIMESTAMP)) AS started, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session(t):
    out = S.run_to_table(S.sessions(S.read_events(t.spark, f"{t.sf_dir}/events.parquet")), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("stream_dedupe", "SELECT event_id FROM events")
def stream_dedupe(t):
    events = S.read_events(t.spark, f"{t.sf_dir}/events.parquet")
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return S.run_to_table(S.distinct_events(twice), "append").select("event_id")


@query("state_stage_timing", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 400) AS slow FROM events GROUP BY 1")
def state_stage_timing(t):
    out = S.run_to_table(S.stage_outcomes(S.read_events(t.spark, f"{t.sf_dir}/events.parquet")), "update")
    return S.latest(out, ["event_type"]).select("event_type", "n", "slow")


@query("state_quota", "SELECT user_id, CAST(ts AS DATE) AS day, least(count(*), 2) AS used, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")
def state_quota(t):
    out = S.run_to_table(S.quota(S.read_events(t.spark, f"{t.sf_dir}/events.parquet"), 2), "update")
    return S.latest(out, ["user_id", "day"]).select("user_id", "day", "used", "rejected")


@query("state_cancel")
def state_cancel(t):
    out = S.run_to_table(S.executions(S.read_events(t.spark, f"{t.sf_dir}/events.parquet")), "update")
    return S.latest(out, ["user_id"]).select("user_id", "state", "n")


@query("last_event_active", "SELECT user_id, arg_max(event_type, (ts, event_id)) IN ('click', 'view') AS active FROM events GROUP BY user_id")
def last_event_active(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).isin("click", "view").alias("active"))


@query("turns_after_day", "WITH kept AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10') SELECT user_id, count(*) AS turns, max(CAST(ts AS TIMESTAMP)) AS last, arg_max(event_id, (ts, event_id)) AS last_id FROM kept GROUP BY user_id")
def turns_after_day(t):
    kept = t.events.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return kept.groupBy("user_id").agg(F.count("*").alias("turns"), F.max("ts").alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("last_role_state", "SELECT conv_id, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'complete' ELSE 'pending' END AS state FROM conversations GROUP BY conv_id")
def last_role_state(t):
    last = F.max_by("role", "turn")
    return t.conversations.groupBy("conv_id").agg(last.alias("last_role"), F.when(last == "assistant", "complete").otherwise("pending").alias("state"))


@query("errors_by_day", "SELECT user_id, CAST(ts AS DATE) AS day, least(count(*) FILTER (event_type = 'error'), 3) AS attempts, count(*) FILTER (event_type = 'error') >= 3 AS exhausted FROM events GROUP BY 1, 2")
def errors_by_day(t):
    errors = F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.least(errors, F.lit(3)).alias("attempts"), (errors >= 3).alias("exhausted"))


@query("state_agent_turns", "SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS thread FROM conversations GROUP BY conv_id")
def state_agent_turns(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: F.substring(x["role"], 1, 1)), "").alias("thread"))


@query("sink_history", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index, left(text, 120) AS title FROM conversations WHERE role = 'user'")
def sink_history(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("turn_index"), F.substring("text", 1, 120).alias("title"))


@query("sink_checklist_md", "SELECT conv_id, string_agg('- [' || CASE WHEN role = 'assistant' THEN 'x' ELSE ' ' END || '] ' || role || ' ' || turn, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id")
def sink_checklist_md(t):
    line = F.concat(F.lit("- ["), F.when(F.col("role") == "assistant", "x").otherwise(" "), F.lit("] "), "role", F.lit(" "), "turn")
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("md"))


@query("sink_embeddings_upsert", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def sink_embeddings_upsert(t):
    old = t.embeddings.select("vec_id", "label", F.lit(0).alias("version"))
    new = t.embeddings.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    return incremental.last_wins(old.unionByName(new), ["vec_id"], [F.desc("version")]).select("vec_id", "label")


@query("mock_classifier", r"SELECT item_id, CASE WHEN contains(lower(text), 'when') THEN 'realtime' ELSE 'search' END AS route FROM benchmark")
def mock_classifier(t):
    return t.benchmark.select("item_id", F.when(F.contains(F.lower("text"), F.lit("when")), "realtime").otherwise("search").alias("route"))


@query("compact_nfkc")
def compact_nfkc(t):
    return t.benchmark.select("item_id", X.nfkc_compact(F.col("text")).alias("text"))
