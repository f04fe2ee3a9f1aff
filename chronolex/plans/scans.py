"""Scans, predicates and scalar functions over the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.functions import text as X
from chronolex.functions import vectors as V
from chronolex.operators import temporal
from chronolex.plans.base import PROVISIONS, SEARCHABLE, VERSIONS, query

DAY = "1996-06-30"


def as_of(day: str = DAY):
    return temporal.valid_on(F.lit(day).cast("date"))


AS_OF = f"(effective_from IS NULL OR effective_from <= DATE '{DAY}') AND (effective_to IS NULL OR effective_to > DATE '{DAY}')"


@query("scan_corpus_flat", f"""WITH {VERSIONS} SELECT c_name AS title, document_id, version_id, effective_from, l_linenumber AS ordinal, l_partkey AS part
FROM versions JOIN customer ON c_custkey = document_id JOIN lineitem ON l_orderkey = version_id WHERE {SEARCHABLE}""")
def scan_corpus_flat(t):
    kept = t.versions.where(temporal.searchable())
    lines = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"))
    titles = t.customer.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return lines.join(kept, "version_id").join(titles, "document_id").select("title", "document_id", "version_id", "effective_from", "ordinal", "part")


@query("scan_source_provisions", f"WITH {PROVISIONS} SELECT provision_id, path, content FROM provisions")
def scan_source_provisions(t):
    return t.provisions.select("provision_id", "path", "content")


@query("scan_v2_source", """SELECT 'MST ' || o_orderkey AS label, strftime(o_orderdate, '%Y-%m-%d') AS effective_from, o_custkey AS document_id FROM orders""")
def scan_v2_source(t):
    return t.orders.select(F.concat(F.lit("MST "), F.col("o_orderkey")).alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_from"), F.col("o_custkey").alias("document_id"))


@query("scan_current_vectors", """SELECT vec_id, label FROM embeddings
WHERE len(embedding) = 64 AND abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.0001""")
def scan_current_vectors(t):
    return t.embeddings.where(F.size("embedding") == 64).where(V.unit_norm(V.doubles(F.col("embedding")))).select("vec_id", "label")


@query("read_vector_text", """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings""")
def read_vector_text(t):
    as_text = t.embeddings.select("vec_id", F.to_json(V.doubles(F.col("embedding"))).alias("v"))
    parsed = as_text.withColumn("p", V.parse_vector(F.col("v")))
    return parsed.select("vec_id", F.size("p").cast("long").alias("dims"), F.round(F.element_at("p", 1), 6).alias("first"))


@query("whitespace_normalize", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS h FROM documents")
def whitespace_normalize(t):
    return t.documents.select("doc_id", H.sha256(X.collapse_whitespace(F.col("text"))).alias("h"))


@query("compact_date_parse", """SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DATE) AS bad FROM orders""")
def compact_date_parse(t):
    written = F.date_format("o_orderdate", "yyyy. MM. dd.")
    return t.orders.select(F.col("o_orderkey").alias("k"), X.compact_date(written).alias("day"), X.compact_date(F.concat(F.lit("9913"), F.date_format("o_orderdate", "dd"), F.lit("99"))).alias("bad"))


@query("passage_text_v1", f"WITH {PROVISIONS} SELECT provision_id, sha256(concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(path), ''), nullif(trim(content), ''))) AS h FROM provisions")
def passage_text_v1(t):
    return t.provisions.select("provision_id", H.sha256(X.passage(F.col("source"), F.col("path"), F.col("content"))).alias("h"))


@query("passage_text_v2", f"WITH {PROVISIONS} SELECT provision_id, sha256(concat_ws(chr(10), nullif(source, ''), nullif(path, ''), nullif(content, ''))) AS h FROM provisions")
def passage_text_v2(t):
    return t.provisions.select("provision_id", H.sha256(X.passage(F.col("source"), F.col("path"), F.col("content"), trim=False)).alias("h"))


@query("passage_text_titled", f"WITH {PROVISIONS} SELECT provision_id, length(source || chr(10) || path || ' (' || lang || ')' || chr(10) || content) AS n FROM provisions")
def passage_text_titled(t):
    made = F.concat("source", F.lit("\n"), "path", F.lit(" ("), "lang", F.lit(")\n"), "content")
    return t.provisions.select("provision_id", F.length(made).cast("long").alias("n"))


@query("content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", H.sha256(F.col("text")).alias("h"))


@query("node_metadata_struct", f"""WITH {PROVISIONS} SELECT provision_id, '{{"lang":"' || lang || '","ordinal":' || ordinal || ',"path":"' || path || '","source":"' || source || '"}}' AS metadata FROM provisions""")
def node_metadata_struct(t):
    fields = {c: F.col(c) for c in ("source", "path", "lang", "ordinal")}
    return t.provisions.select("provision_id", H.canonical_json(**fields).alias("metadata"))


@query("article_root", f"WITH {PROVISIONS} SELECT string_split(path, '/')[1] AS root, count(*) AS n FROM provisions GROUP BY 1")
def article_root(t):
    return t.provisions.groupBy(X.article_root(F.col("path")).alias("root")).agg(F.count("*").alias("n"))


@query("filter_as_of", f"WITH {VERSIONS} SELECT document_id, version_id, effective_from, effective_to FROM versions WHERE {AS_OF}")
def filter_as_of(t):
    return t.versions.where(as_of()).select("document_id", "version_id", "effective_from", "effective_to")


@query("filter_searchable", f"WITH {VERSIONS} SELECT version_id, lifecycle_state FROM versions WHERE {SEARCHABLE}")
def filter_searchable(t):
    return t.versions.where(temporal.searchable()).select("version_id", "lifecycle_state")


@query("gate_exists", """SELECT n_name AS title FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AND EXISTS (SELECT 1 FROM region WHERE r_regionkey = 0)""")
def gate_exists(t):
    t.nation.createOrReplaceTempView("gated_nation")
    t.region.createOrReplaceTempView("gate")
    return t.spark.sql("SELECT n_name AS title FROM gated_nation WHERE EXISTS (SELECT 1 FROM gate WHERE r_name = 'ASIA') AND EXISTS (SELECT 1 FROM gate WHERE r_regionkey = 0)")


@query("gate_capability_reason", """SELECT n_name AS title, CASE WHEN n_regionkey >= 4 THEN 'capability missing' ELSE coalesce(nullif(r_name, 'ASIA'), 'not ready') END AS reason
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def gate_capability_reason(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    reason = F.when(F.col("n_regionkey") >= 4, "capability missing").otherwise(F.coalesce(F.nullif("r_name", F.lit("ASIA")), F.lit("not ready")))
    return joined.select(F.col("n_name").alias("title"), reason.alias("reason"))


@query("filter_title_nullable", "SELECT count(*) AS n_all, count(*) FILTER (p_brand = 'Brand#11') AS n_titled FROM part")
def filter_title_nullable(t):
    titled = lambda title: F.lit(True) if title is None else F.col("p_brand") == title
    return t.part.agg(F.count_if(titled(None)).alias("n_all"), F.count_if(titled("Brand#11")).alias("n_titled"))


@query("filter_source_kind", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3')")
def filter_source_kind(t):
    return t.documents.where(F.col("source").isin("src0", "src3")).select("doc_id", "source")


@query("filter_allowed_url", r"""SELECT page_id, coalesce(regexp_matches(lower(url), '^https://([a-z0-9.-]+\.)?example\.(com|org)(:443)?([/?#]|$)'), false) AS allowed FROM pages""")
def filter_allowed_url(t):
    return t.pages.select("page_id", X.allowed_url(F.col("url"), ("example.com", "example.org")).alias("allowed"))


@query("filter_document_kind", """SELECT p_partkey, CASE WHEN p_type LIKE '%ECONOMY%' THEN 'act' WHEN p_type LIKE '%SMALL%' THEN 'decree' WHEN p_name LIKE '%a%' THEN 'rule' ELSE 'admin' END AS kind FROM part""")
def filter_document_kind(t):
    kind = F.when(F.contains("p_type", F.lit("ECONOMY")), "act").when(F.contains("p_type", F.lit("SMALL")), "decree").when(F.contains("p_name", F.lit("a")), "rule").otherwise("admin")
    return t.part.select("p_partkey", kind.alias("kind"))


@query("supported_date_guard", f"""WITH {VERSIONS} SELECT min(effective_from) AS supported_from, max(effective_from) AS supported_through,
DATE '{DAY}' BETWEEN min(effective_from) AND max(effective_from) AS supported FROM versions WHERE {SEARCHABLE}""")
def supported_date_guard(t):
    bounds = t.versions.where(temporal.searchable()).agg(F.min("effective_from").alias("supported_from"), F.max("effective_from").alias("supported_through"))
    return bounds.withColumn("supported", F.lit(DAY).cast("date").between(F.col("supported_from"), F.col("supported_through")))


@query("path_membership", f"WITH {PROVISIONS} SELECT provision_id, path FROM provisions WHERE path IN (SELECT 'd' || i || '/p' || (i % 3) FROM generate_series(0, 199) AS g(i))")
def path_membership(t):
    asked = t.spark.range(200).select(F.concat(F.lit("d"), F.col("id"), F.lit("/p"), F.col("id") % 3).alias("path"))
    return t.provisions.join(F.broadcast(asked), "path").select("provision_id", "path")


@query("embedding_eligible", f"WITH {VERSIONS} SELECT version_id, record_state = 'available' AND (lifecycle_state <> 'abolished' OR effective_to IS NOT NULL) AS eligible FROM versions")
def embedding_eligible(t):
    eligible = (F.col("record_state") == "available") & ((F.col("lifecycle_state") != "abolished") | F.col("effective_to").isNotNull())
    return t.versions.select("version_id", eligible.alias("eligible"))


@query("input_validation", """SELECT count(*) FILTER (len(embedding) <> 64) AS wrong_dims, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.00002) AS not_unit,
count(*) - count(DISTINCT vec_id) AS repeated_ids FROM embeddings""")
def input_validation(t):
    v = V.doubles(F.col("embedding"))
    return t.embeddings.agg(
        F.count_if(F.size("embedding") != 64).alias("wrong_dims"), F.count_if(~(V.is_finite(v) & V.unit_norm(v, 2e-5))).alias("not_unit"), (F.count("*") - F.count_distinct("vec_id")).alias("repeated_ids")
    )


@query("cosine_clip", """SELECT a.vec_id AS id, round(least(1, greatest(-1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS c
FROM embeddings a JOIN embeddings b ON b.vec_id = 0""")
def cosine_clip(t):
    first = t.embeddings.where("vec_id = 0").select(V.doubles(F.col("embedding")).alias("q"))
    return t.embeddings.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("id"), F.round(V.cosine(V.doubles(F.col("embedding")), F.col("q")), 6).alias("c"))


@query("vector_norm", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norm(t):
    return t.embeddings.select("vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 6).alias("norm"))


@query("l2_slice_normalize", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[1:16] AS DOUBLE[]))), 6) AS first FROM embeddings""")
def l2_slice_normalize(t):
    return t.embeddings.select("vec_id", F.round(F.element_at(V.head_normalised(V.doubles(F.col("embedding")), 16), 1), 6).alias("first"))


@query("max_abs_diff", """SELECT a.vec_id, round(list_max(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: abs(z[1] - z[2]))), 6) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def max_abs_diff(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select("vec_id", F.round(V.max_abs_difference(V.doubles(F.col("embedding")), V.doubles(F.col("other"))), 6).alias("d"))


@query("normalize_alnum", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS name FROM part")
def normalize_alnum(t):
    return t.part.select("p_partkey", X.keep_alphanumeric(F.col("p_name")).alias("name"))


@query("nfkc_casefold")
def nfkc_casefold(t):
    return t.documents.select("doc_id", H.sha256(X.nfkc_casefold(F.col("text"))).alias("h"))


@query("compact_text", r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g')) AS h FROM documents")  # as far as NFKC changes nothing
def compact_text(t):
    return t.documents.select("doc_id", X.compact_text(F.col("text")).alias("c")).select("doc_id", H.sha256(F.col("c")).alias("h"))


@query("strip_suffix_longest_list", """SELECT p_partkey, CASE WHEN w LIKE '%ings' AND length(w) >= 6 THEN left(w, length(w) - 4) WHEN w LIKE '%ing' AND length(w) >= 5 THEN left(w, length(w) - 3)
WHEN w LIKE '%s' AND length(w) >= 3 THEN left(w, length(w) - 1) WHEN w LIKE '%e' AND length(w) >= 3 THEN left(w, length(w) - 1) ELSE w END AS stem
FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w FROM part)""")
def strip_suffix_longest_list(t):
    return t.part.select("p_partkey", X.strip_endings(F.split("p_name", " ")[0], ("ings", "ing", "s", "e")).alias("stem"))


@query("tokenize_terms", r"""SELECT item_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(ws), lambda w: list_position(ws, w))), 1, 5), lambda p: ws[p]), ' ') AS terms
FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'and')) AS ws FROM benchmark)""")
def tokenize_terms(t):
    return t.benchmark.select("item_id", F.array_join(X.terms(F.col("text"), ("the", "of", "and")), " ").alias("terms"))


@query("alias_expand", """SELECT n_nationkey, n_name || CASE WHEN n_regionkey = 0 THEN ',africa' WHEN n_regionkey = 2 THEN ',asia,east' ELSE '' END AS terms FROM nation""")
def alias_expand(t):
    aliases = {"0": ["africa"], "2": ["asia", "east"]}
    keys = F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))
    found = F.filter(X.expand_aliases(keys, aliases), lambda x: x != F.col("n_regionkey").cast("string"))
    return t.nation.select("n_nationkey", F.array_join(found, ",").alias("terms"))


@query("matching_terms", """SELECT doc_id, (CASE WHEN contains(lower(text), 'idiot') THEN 'idiot ' ELSE '' END) || (CASE WHEN contains(lower(text), 'license') THEN 'license ' ELSE '' END) AS m FROM documents""")
def matching_terms(t):
    found = X.matching(F.array(F.lit("idiot"), F.lit("license")), F.lower("text"))
    return t.documents.select("doc_id", F.array_join(F.transform(found, lambda w: F.concat(w, F.lit(" "))), "").alias("m"))


@query("anchor_select", """SELECT item_id, arg_min(w, struct_pack(n := n, l := -length(w), w := w)) AS anchor FROM (
SELECT item_id, w, (SELECT count(*) FROM nation WHERE contains(lower(n_name), left(w, 2))) AS n FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark)) GROUP BY item_id""")
def anchor_select(t):
    words = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    heads = words.select(F.substring("w", 1, 2).alias("head")).distinct().crossJoin(F.broadcast(t.nation.select(F.lower("n_name").alias("title"))))
    counts = heads.groupBy("head").agg(F.count_if(F.contains("title", F.col("head"))).alias("n"))
    joined = words.join(counts, F.substring("w", 1, 2) == F.col("head"))
    return joined.groupBy("item_id").agg(F.min_by("w", F.struct("n", -F.length("w"), "w")).alias("anchor"))


@query("query_plans", r"""SELECT item_id, ws[1] || ' AND ' || ws[2] || ' AND ' || ws[3] AS strict, '(' || ws[1] || ' AND ' || ws[2] || ') OR (' || ws[1] || ' AND ' || ws[3] || ') OR (' || ws[2] || ' AND ' || ws[3] || ')' AS pairwise
FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) >= 3""")
def query_plans(t):
    ws = t.benchmark.select("item_id", F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 3).alias("ws")).where(F.size("ws") == 3)
    pair = lambda i, j: F.concat(F.lit("("), F.col("ws")[i], F.lit(" AND "), F.col("ws")[j], F.lit(")"))
    return ws.select("item_id", F.array_join("ws", " AND ").alias("strict"), F.concat_ws(" OR ", pair(0, 1), pair(0, 2), pair(1, 2)).alias("pairwise"))


ROUTE = r"CASE WHEN regexp_matches(lower(text), '^(is|are)\b') THEN 'realtime' WHEN contains(lower(text), 'ation') AND length(text) > 200 THEN 'document' WHEN regexp_matches(lower(text), '\bif\b|\bfor\b') THEN 'conditional' ELSE 'search' END"


def route_of(text):
    """The first rule that fits a question decides its route; plain search is the rest."""
    low = F.lower(text)
    return F.when(low.rlike(r"^(is|are)\b"), "realtime").when(F.contains(low, F.lit("ation")) & (F.length(text) > 200), "document").when(low.rlike(r"\bif\b|\bfor\b"), "conditional").otherwise("search")


@query("route_rules", f"SELECT item_id, {ROUTE} AS route FROM benchmark")
def route_rules(t):
    return t.benchmark.select("item_id", route_of(F.col("text")).alias("route"))


@query("trigram_set_jaccard", """WITH g AS (SELECT n_nationkey, list_distinct(list_transform(generate_series(1, greatest(length(replace(n_name, ' ', '')) - 2, 0)), lambda i: substring(replace(n_name, ' ', ''), i, 3))) AS s FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS j FROM g a JOIN g b ON a.n_nationkey < b.n_nationkey""")
def trigram_set_jaccard(t):
    g = t.nation.select("n_nationkey", X.trigrams(F.col("n_name")).alias("s"))
    other = F.broadcast(g.select(F.col("n_nationkey").alias("b"), F.col("s").alias("r")))
    return g.join(other, F.col("n_nationkey") < F.col("b")).select(F.col("n_nationkey").alias("a"), "b", F.round(X.jaccard(F.col("s"), F.col("r")), 6).alias("j"))


@query("sequence_ratio")
def sequence_ratio(t):
    a = t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"))
    b = F.broadcast(t.nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.sequence_ratio("x", "y"), 6).alias("ratio"))


@query("token_estimate", r"""SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[!-~]+'), lambda r: ceil(length(r) / 3))), 0) + length(regexp_replace(text, '[!-~\s]', '', 'g')) AS BIGINT) AS tokens FROM conversations""")
def token_estimate(t):
    return t.conversations.select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


@query("approx_tokens", "SELECT doc_id, CAST(round_even(n_chars / 2.2, 0) AS BIGINT) AS tokens FROM documents")
def approx_tokens(t):
    return t.documents.select("doc_id", X.approximate_tokens(F.col("n_chars")).alias("tokens"))


@query("title_from_question", r"SELECT conv_id, turn, left(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 120) AS title FROM conversations WHERE role = 'user'")
def title_from_question(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", X.title_of(F.col("text")).alias("title"))


@query("ellipsize", "SELECT item_id, CASE WHEN length(text) <= 100 THEN text ELSE rtrim(left(text, 99)) || '…' END AS short FROM benchmark")
def ellipsize(t):
    return t.benchmark.select("item_id", X.ellipsize(F.col("text"), 100).alias("short"))


@query("scalar_greatest_least", """SELECT o_orderkey, greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l, nullif(o_orderstatus, 'P') AS n, coalesce(nullif(o_orderstatus, 'P'), 'none') AS c FROM orders""")
def scalar_greatest_least(t):
    return t.orders.select("o_orderkey", F.greatest("o_custkey", "o_orderkey").alias("g"), F.least("o_custkey", "o_orderkey").alias("l"), F.nullif("o_orderstatus", F.lit("P")).alias("n"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("c"))


@query("json_extract_build", """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS made FROM events""")
def json_extract_build(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("made"))


@query("truthy_markers", r"""SELECT page_id, regexp_matches(lower(html), '<(script|style)\b') AS scripted, regexp_matches(lower(html), '<(nav|footer)\b') AS framed FROM pages""")
def truthy_markers(t):
    low = F.lower("html")
    return t.pages.select("page_id", low.rlike(r"<(script|style)\b").alias("scripted"), low.rlike(r"<(nav|footer)\b").alias("framed"))


@query("date_windows", """SELECT user_id, greatest(CAST(max(ts) AS DATE) - 1, DATE '2024-01-01' - 7) AS window_from FROM events WHERE event_type = 'error' GROUP BY user_id""")
def date_windows(t):
    last = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("d"))
    return last.select("user_id", F.greatest(F.date_sub("d", 1), F.date_sub(F.lit("2024-01-01").cast("date"), 7)).alias("window_from"))


@query("expire_at", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS expires, CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR <= TIMESTAMP '1998-01-01' AS expired FROM orders""")
def expire_at(t):
    expires = F.add_months(F.to_date("o_orderdate"), 12)
    return t.orders.select("o_orderkey", expires.alias("expires"), (expires <= F.lit("1998-01-01").cast("date")).alias("expired"))


@query("stage_timeout", "SELECT event_id, CASE WHEN least(8000, 52000 - CAST(floor(value) * 1000 AS BIGINT) - 3000) > 0 THEN least(8000, 52000 - CAST(floor(value) * 1000 AS BIGINT) - 3000) END AS ms FROM events WHERE value IS NOT NULL")
def stage_timeout(t):
    left = F.least(F.lit(8000).cast("long"), 52000 - (F.floor("value") * 1000).cast("long") - 3000)
    return t.events.where("value is not null").select("event_id", F.when(left > 0, left).alias("ms"))


@query("retry_delay", "SELECT i AS attempt, least(0.5 * pow(2, i), 30) AS seconds FROM generate_series(0, 9) AS g(i)")
def retry_delay(t):
    return t.spark.range(10).select(F.col("id").alias("attempt"), F.least(0.5 * F.pow(F.lit(2.0), F.col("id")), F.lit(30.0)).alias("seconds"))
