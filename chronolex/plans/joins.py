"""Joins and set operations over the corpus views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.operators import incremental, retrieval, selection, temporal
from chronolex.plans.base import PROVISIONS, VERSIONS, query
from chronolex.plans.scans import AS_OF, as_of


@query("join_corpus3", f"WITH {VERSIONS} SELECT c_mktsegment AS kind, count(*) AS n, count(DISTINCT version_id) AS n_versions FROM lineitem JOIN versions ON l_orderkey = version_id JOIN customer ON c_custkey = document_id WHERE {AS_OF} GROUP BY 1")
def join_corpus3(t):
    corpus = t.lineitem.join(t.versions.where(as_of()), F.col("l_orderkey") == F.col("version_id")).join(t.customer, F.col("c_custkey") == F.col("document_id"))
    return corpus.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("version_id").alias("n_versions"))


@query("join_profile_composite", "SELECT vec_id, key AS profile FROM embeddings JOIN (VALUES ('even', 0, 64), ('odd', 1, 64), ('none', 0, 32)) AS p(key, parity, dims) ON label % 2 = parity AND len(embedding) = dims")
def join_profile_composite(t):
    profiles = t.spark.createDataFrame([("even", 0, 64), ("odd", 1, 64), ("none", 0, 32)], "profile string, parity int, dims int")
    return t.embeddings.join(F.broadcast(profiles), (F.col("label") % 2 == F.col("parity")) & (F.size("embedding") == F.col("dims"))).select("vec_id", "profile")


@query("join_paths_ordinality", f"WITH {PROVISIONS} SELECT provision_id, CAST(list_position(['d7/p0', 'd3/p0', 'd5/p0', 'd1/p9999'], path) - 1 AS INTEGER) AS place FROM provisions WHERE path IN ('d7/p0', 'd3/p0', 'd5/p0', 'd1/p9999')")
def join_paths_ordinality(t):
    asked = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in ("d7/p0", "d3/p0", "d5/p0", "d1/p9999")])).alias("place", "path"))
    return t.provisions.join(F.broadcast(asked), "path").select("provision_id", "place")


@query("join_left_embeddings", "SELECT doc_id, vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def join_left_embeddings(t):
    return t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", F.col("vec_id").isNull().alias("missing"))


@query("join_full_rrf", """WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT coalesce(x.id, y.id) AS item_id, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0), 9) AS score FROM (SELECT * FROM a WHERE r <= 50) x FULL JOIN (SELECT * FROM b WHERE r <= 50) y ON x.id = y.id""")
def join_full_rrf(t):
    rows = t.orders.select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("item_id"), "o_totalprice", "o_orderdate")
    a = retrieval.top(rows, ["query_id"], [F.desc("o_totalprice"), F.asc("item_id")], 50)
    b = retrieval.top(rows, ["query_id"], [F.desc("o_orderdate"), F.asc("item_id")], 50)
    return retrieval.reciprocal_rank_fusion(a, b).select("item_id", F.round("score", 9).alias("score"))


@query("join_cross_scalar", "SELECT n_name, total FROM nation CROSS JOIN (SELECT count(*) AS total FROM customer)")
def join_cross_scalar(t):
    return t.nation.crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("total")))).select("n_name", "total")


@query("join_overlap_self", f"""WITH {VERSIONS} SELECT a.document_id, a.version_id AS left_id, b.version_id AS right_id FROM versions a JOIN versions b ON a.document_id = b.document_id AND a.version_id < b.version_id
AND a.effective_from < coalesce(b.effective_to, DATE '9999-12-31') AND b.effective_from < coalesce(a.effective_to, DATE '9999-12-31')""")
def join_overlap_self(t):
    return temporal.overlaps(t.versions)


@query("join_semi_exists", "SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'system')")
def join_semi_exists(t):
    return t.conversations.select("conv_id").distinct().join(t.conversations.where("role = 'system'"), "conv_id", "left_semi")


@query("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti_not_exists(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_update_delete_using", "SELECT conv_id, turn FROM conversations WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = conv_id AND event_type = 'error' AND value > 95)")
def join_update_delete_using(t):
    gone = t.events.where("event_type = 'error' and value > 95").select(F.col("user_id").alias("conv_id")).distinct()
    return t.conversations.join(gone, "conv_id", "left_anti").select("conv_id", "turn")


def _incoming(t):
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" *"))).otherwise(F.col("text"))
    rows = t.documents.where("doc_id % 7 <> 0").select("doc_id", changed.alias("text"), "lang", F.when(F.col("doc_id") % 11 == 0, "moved").otherwise(F.col("source")).alias("source"))
    return rows.unionByName(t.documents.where("doc_id % 50 = 1").select((F.col("doc_id") + 1000000).alias("doc_id"), "text", "lang", "source"))


INCOMING = """incoming AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' *' ELSE text END AS text, lang, CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id + 1000000, text, lang, source FROM documents WHERE doc_id % 50 = 1)"""


@query("join_two_corpora_diff", f"""WITH {INCOMING} SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN i.doc_id IS NULL THEN 'removed'
WHEN s.text IS DISTINCT FROM i.text OR s.source IS DISTINCT FROM i.source THEN 'updated' ELSE 'unchanged' END AS state,
s.doc_id IS NOT NULL AND i.doc_id IS NOT NULL AND s.text IS DISTINCT FROM i.text AS stale_embedding FROM documents s FULL JOIN incoming i ON s.doc_id = i.doc_id""")
def join_two_corpora_diff(t):
    found = incremental.diff(t.documents.select("doc_id", "text", "lang", "source"), _incoming(t), "doc_id", ["text", "source"], ["text"])
    return found.select("doc_id", "state", "stale_embedding")


@query("join_overlay", f"""WITH {INCOMING}, gone AS (SELECT doc_id FROM documents WHERE doc_id % 13 = 0) SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND doc_id NOT IN (SELECT doc_id FROM incoming) UNION ALL SELECT doc_id, sha256(text) FROM incoming""")
def join_overlay(t):
    stored = t.documents.select("doc_id", "text")
    made = incremental.overlay(stored, _incoming(t), t.documents.where("doc_id % 13 = 0"), "doc_id", "doc_id")
    return made.select("doc_id", F.sha2("text", 256).alias("h"))


@query("join_cross_collision", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey <> b.l_partkey GROUP BY 1, 2")
def join_cross_collision(t):
    a, b = t.lineitem.alias("a"), t.lineitem.alias("b")
    hit = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") == F.col("b.l_linenumber")) & (F.col("a.l_partkey") != F.col("b.l_partkey")))
    return hit.groupBy("a.l_orderkey", "a.l_linenumber").agg(F.count("*").alias("n"))


@query("join_candidates_to_population", "SELECT vec_id, lang, doc_id IS NOT NULL AS in_population FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3")
def join_candidates_to_population(t):
    return t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id") * 3, "left").select("vec_id", "lang", F.col("doc_id").isNotNull().alias("in_population"))


@query("join_parent_heading", f"WITH {PROVISIONS} SELECT c.provision_id, left(p.content, 30) AS heading FROM provisions c JOIN provisions p ON p.doc_id = c.doc_id AND p.ordinal = 0 WHERE c.ordinal > 0")
def join_parent_heading(t):
    roots = t.provisions.where("ordinal = 0").select("doc_id", F.substring("content", 1, 30).alias("heading"))
    return t.provisions.where("ordinal > 0").join(roots, "doc_id").select("provision_id", "heading")


@query("join_subtree", f"WITH {PROVISIONS} SELECT doc_id, sha256(string_agg(content, chr(10) ORDER BY ordinal)) AS h, count(*) AS n_nodes FROM provisions GROUP BY doc_id")
def join_subtree(t):
    return selection.subtree_text(t.provisions, ["doc_id"], "ordinal", "content").select("doc_id", F.sha2("text", 256).alias("h"), "n_nodes")


@query("join_control_pairs", "SELECT a.item_id AS a, b.item_id AS b, length(a.text) - length(b.text) AS delta FROM benchmark a JOIN benchmark b ON a.item_id // 2 = b.item_id // 2 AND a.item_id < b.item_id")
def join_control_pairs(t):
    pair = F.floor(F.col("item_id") / 2)
    a = t.benchmark.select(F.col("item_id").alias("a"), pair.alias("pair"), F.length("text").alias("x"))
    b = t.benchmark.select(F.col("item_id").alias("b"), pair.alias("pair"), F.length("text").alias("y"))
    return a.join(b, "pair").where("a < b").select("a", "b", (F.col("x") - F.col("y")).cast("long").alias("delta"))


@query("join_near_duplicates", r"""WITH q AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '\s', '', 'g') AS s FROM conversations WHERE role = 'user'),
g AS (SELECT id, list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substring(s, i, 3))) AS s FROM q WHERE length(s) >= 3)
SELECT a.id AS left_id, b.id AS right_id FROM g a JOIN g b ON a.id < b.id AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.3""")
def join_near_duplicates(t):
    rows = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return retrieval.near_duplicate_pairs(rows, 0.3).select("left_id", "right_id")


@query("join_history_user", "SELECT c_custkey, count(*) AS n FROM events JOIN customer ON lower('CUST-' || user_id) = lower('Cust-' || c_custkey) GROUP BY c_custkey")
def join_history_user(t):
    who = t.customer.select("c_custkey", F.lower(F.concat(F.lit("Cust-"), "c_custkey")).alias("k"))
    return t.events.select(F.lower(F.concat(F.lit("CUST-"), "user_id")).alias("k")).join(who, "k").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("asof_batch", f"""WITH {VERSIONS}, days AS (SELECT DATE '1994-01-01' + CAST(i * 120 AS INTEGER) AS day FROM generate_series(0, 9) AS g(i))
SELECT day, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM days JOIN versions ON (effective_from <= day) AND (effective_to IS NULL OR effective_to > day) GROUP BY day""")
def asof_batch(t):
    days = t.spark.range(10).select(F.expr("date_add(date'1994-01-01', cast(id * 120 as int))").alias("day"))
    rows = t.versions.join(F.broadcast(days), temporal.valid_on(F.col("day")))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"))


@query("set_diff_ids", f"WITH {INCOMING} SELECT 'new' AS side, count(*) AS n FROM (SELECT doc_id FROM incoming EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'removed', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM incoming) UNION ALL SELECT 'shared', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM incoming)")
def set_diff_ids(t):
    a, b = t.documents.select("doc_id"), _incoming(t).select("doc_id")
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return part("new", b.exceptAll(a)).unionByName(part("removed", a.exceptAll(b))).unionByName(part("shared", a.intersect(b)))


@query("set_equality_contract", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS equal")
def set_equality_contract(t):
    a, b = t.labels.select("doc_id", F.lit(1).alias("x")), t.documents.select("doc_id", F.lit(1).alias("y"))
    return a.join(b, "doc_id", "full").agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("equal"))


@query("set_union_pool", "SELECT label, CAST(len(list_distinct(list(id))) AS BIGINT) AS n_pool FROM (SELECT label, vec_id AS id FROM embeddings UNION ALL SELECT label, vec_id // 2 FROM embeddings) GROUP BY label")
def set_union_pool(t):
    lists = t.embeddings.groupBy("label").agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("vec_id"), F.floor(F.col("vec_id") / 2))))).alias("pool"))
    return lists.select("label", F.size("pool").cast("long").alias("n_pool"))


@query("set_subset", "SELECT NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS labels_in_documents, NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AS documents_in_labels")
def set_subset(t):
    missing = lambda a, b: a.join(b, "doc_id", "left_anti").agg((F.count("*") == 0).alias("ok"))
    one = missing(t.labels.select("doc_id"), t.documents.select("doc_id")).withColumnRenamed("ok", "labels_in_documents")
    return one.crossJoin(F.broadcast(missing(t.documents.select("doc_id"), t.labels.select("doc_id")).withColumnRenamed("ok", "documents_in_labels")))


@query("set_changed_nodes", f"WITH {INCOMING} SELECT i.doc_id FROM incoming i LEFT JOIN documents s ON s.doc_id = i.doc_id WHERE sha256(s.text) IS DISTINCT FROM sha256(i.text)")
def set_changed_nodes(t):
    held = t.documents.select("doc_id", F.sha2("text", 256).alias("held"))
    return _incoming(t).select("doc_id", F.sha2("text", 256).alias("h")).join(held, "doc_id", "left").where(~F.col("h").eqNullSafe(F.col("held"))).select("doc_id")


@query("set_symmetric_population", "SELECT coalesce(a.d, b.d) AS day, a.d IS NOT NULL AS declared, b.d IS NOT NULL AS current FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P') a FULL JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity > 45) b ON a.d = b.d")
def set_symmetric_population(t):
    a = t.orders.where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day"), F.lit(True).alias("x")).distinct()
    b = t.lineitem.where("l_quantity > 45").select(F.to_date("l_shipdate").alias("day"), F.lit(True).alias("y")).distinct()
    return a.join(b, "day", "full").select("day", F.col("x").isNotNull().alias("declared"), F.col("y").isNotNull().alias("current"))


@query("set_jaccard_top10", """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) AS b FROM embeddings)
SELECT label, round(count(*) FILTER (a <= 10 AND b <= 10) / count(*) FILTER (a <= 10 OR b <= 10), 9) AS j FROM r GROUP BY label""")
def set_jaccard_top10(t):
    w = lambda i: Window.partitionBy("label").orderBy(F.desc(F.element_at("embedding", i)), "vec_id")
    r = t.embeddings.select("label", "vec_id", F.row_number().over(w(1)).alias("a"), F.row_number().over(w(2)).alias("b"))
    sets = r.groupBy("label").agg(F.collect_list(F.when(F.col("a") <= 10, F.col("vec_id"))).alias("x"), F.collect_list(F.when(F.col("b") <= 10, F.col("vec_id"))).alias("y"))
    return sets.select("label", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 9).alias("j"))
