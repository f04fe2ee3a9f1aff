"""Question banks, reviewed judgments, numbered sections and evaluation files over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators import audits
from chronolex.plans.aggregates import HITS, hits
from chronolex.plans.base import PROVISIONS, query
from chronolex.sources import parsers
from chronolex.sources.shared import new_folder

#: What stands before a line, by its place: a section number, a date, and numbers that sentences only name.
_BEFORE = ("", "2024.1.2 가 ", "3.5부터 가 ", "1.5 및 나 ", "")


@query("split_numbered_sections", f"""WITH {PROVISIONS}, l AS (SELECT doc_id, ordinal AS i, (ordinal + doc_id) % 5 = 0 AS opens, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS x FROM provisions),
m AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s, count(*) FILTER (opens) OVER (PARTITION BY doc_id) AS n,
  trim(CASE WHEN opens THEN (i // 5 + 1) || '.' || (i % 7) || ' 가 ' ELSE ['', '2024.1.2 가 ', '3.5부터 가 ', '1.5 및 나 ', ''][(i + doc_id) % 5 + 1] END || x) AS y FROM l)
SELECT doc_id, greatest(s, 1) AS section, max((i // 5 + 1) || '.' || (i % 7)) FILTER (opens) AS number, sha256(string_agg(y, ' ' ORDER BY i) FILTER (y <> '')) AS h FROM m WHERE n >= 2 GROUP BY 1, 2""")
def split_numbered_sections(t):
    """Documents as one string each, every fifth line with a section number, the others with dates and named numbers."""
    place = F.pmod(F.col("ordinal") + F.col("doc_id"), F.lit(5))
    number = F.concat(F.floor(F.col("ordinal") / 5) + 1, F.lit("."), F.col("ordinal") % 7, F.lit(" 가 "))
    before = F.when(place == 0, number).otherwise(F.element_at(F.array(*[F.lit(x) for x in _BEFORE]), (place + 1).cast("int")))
    line = F.trim(F.concat(before, F.trim(F.regexp_replace("content", r"\s+", " "))))
    rows = t.provisions.select("doc_id", "ordinal", line.alias("line")).where("line <> ''")
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), " ").alias("text"))
    cut = whole.select("doc_id", F.posexplode(parsers.standard_sections(F.col("text"))).alias("k", "s"))
    return cut.select("doc_id", (F.col("k") + 1).cast("long").alias("section"), F.col("s.number").alias("number"), F.sha2("s.text", 256).alias("h"))


_RECORD = "provision_id long, document_id long, path string, parent_path string, heading string, content string, ordinal int"


@query("load_eval_jsonl", f"""WITH {PROVISIONS}, p AS (SELECT *, ordinal // 3 AS article FROM provisions), d AS (SELECT doc_id, count(*) AS direct FROM labels WHERE quality = 1 AND toxic = 0 GROUP BY 1)
SELECT doc_id AS document_id, article, count(*) AS n_children, sha256(string_agg(provision_id, ',' ORDER BY ordinal)) AS children, any_value(direct) AS direct FROM p LEFT JOIN d USING (doc_id) WHERE ordinal % 3 <> 0 GROUP BY 1, 2""")
def load_eval_jsonl(t):
    """Corpus and judgments as JSON lines, with blank lines between them, read back as indexes."""
    folder = new_folder(t.spark, "evaluation")
    article = F.floor(F.col("ordinal") / 3)
    path = lambda n: F.concat(F.lit("a"), n)
    child = F.col("ordinal") % 3 != 0
    rows = t.provisions.select(
        "provision_id", F.col("doc_id").alias("document_id"), F.when(child, F.concat(path(article), F.lit("/p"), F.col("ordinal") % 3)).otherwise(path(article)).alias("path"), F.when(child, path(article)).alias("parent_path"),
        F.lit(None).cast("string").alias("heading"), "content", "ordinal",
    )
    lines = rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit("  "))).alias("value"))
    lines.write.text(f"{folder}/corpus")
    judged = t.labels.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("provision_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).otherwise(F.col("quality")).alias("relevance"))
    judged.select(F.to_json(F.struct(*judged.columns)).alias("value")).write.text(f"{folder}/judgments")
    records = parsers.read_jsonl(t.spark, f"{folder}/corpus", _RECORD)
    _, children = parsers.corpus_index(records, "provision_id")
    direct = parsers.read_jsonl(t.spark, f"{folder}/judgments", "case_id long, provision_id long, relevance int").where("relevance = 2").groupBy(F.col("case_id").alias("document_id")).agg(F.count("*").alias("direct"))
    found = children.join(direct, "document_id", "left")
    return found.select("document_id", F.substring("parent_path", 2, 20).cast("long").alias("article"), F.size("children").cast("long").alias("n_children"), F.sha2(F.array_join("children", ","), 256).alias("children"), "direct")


_ASK = r"trim(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '\s+', ' ', 'g'))"


@query("m_bank_audit", f"""WITH q AS (SELECT doc_id, doc_id % 11 AS k, left({_ASK}, 60) || ' ' || doc_id AS base, doc_id % 7 AS intent FROM documents),
x AS (SELECT *, base || CASE k WHEN 1 THEN ' 제 3 조?' WHEN 2 THEN ' {{x}}?' WHEN 3 THEN '.' WHEN 4 THEN repeat('z', 120) || '?' ELSE '?' END AS question FROM q)
SELECT 'forbidden' AS rule, CAST(doc_id AS VARCHAR) AS id FROM x WHERE k = 1 UNION ALL SELECT 'malformed', CAST(doc_id AS VARCHAR) FROM x WHERE k IN (2, 3) UNION ALL SELECT 'length', CAST(doc_id AS VARCHAR) FROM x WHERE length(trim(question)) NOT BETWEEN 15 AND 120
UNION ALL SELECT 'hash', CAST(doc_id AS VARCHAR) FROM x WHERE k = 5 UNION ALL SELECT 'intent_count', CAST(intent AS VARCHAR) FROM x GROUP BY intent HAVING count(*) <> (SELECT count(*) // 7 FROM x)""")
def m_bank_audit(t):
    """First lines as questions with their number, some with a planted fault; near copies, which SQL can't tell, are held against difflib in the tests."""
    k = F.col("doc_id") % 11
    first = F.trim(F.regexp_replace(F.coalesce(F.get(F.split("text", "\n", -1), F.lit(0)), F.lit("")), r"\s+", " "))
    base = F.concat(F.substring(first, 1, 60), F.lit(" "), "doc_id")
    end = F.when(k == 1, " 제 3 조?").when(k == 2, " {x}?").when(k == 3, ".").when(k == 4, "z" * 120 + "?").otherwise("?")
    question = F.concat(base, end)
    bank = t.documents.select(F.col("doc_id").alias("id"), question.alias("question"), F.when(k == 5, "0").otherwise(F.sha2(question, 256)).alias("question_sha256"), (F.col("doc_id") % 7).alias("intent"))
    even = t.documents.agg(F.floor(F.count("*") / 7).alias("n"))
    expected = bank.select("intent").distinct().crossJoin(even)  # one row
    return audits.bank_faults(bank, expected).where("rule <> 'near_copy'")


_REVIEW = ("approved", "modified", "on_hold")


@query("m_judgment_rules", f"""WITH {HITS}, c AS (SELECT query_id, query_id // 50 % 9 AS k, list(vec_id ORDER BY rank) AS ids FROM hits WHERE rank <= 10 GROUP BY 1),
j AS (SELECT query_id, k, CASE WHEN k IN (0, 1, 4, 5, 6, 7) THEN list_slice(ids, 1, 2) WHEN k = 8 THEN [] END AS direct, CASE WHEN k IN (0, 1, 4, 5, 6, 7, 8) THEN list_slice(ids, 4, 5) END AS irrelevant, ids FROM c)
SELECT query_id, CASE k WHEN 7 THEN 'not_answerable_from_current_corpus' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'answerable' END AS verdict,
  array_to_string(CASE k WHEN 4 THEN list_concat(direct, [ids[1]]) WHEN 5 THEN list_concat(direct, [-1]) WHEN 6 THEN list_concat(direct, [ids[4]]) ELSE direct END, ',') AS direct,
  CASE k WHEN 2 THEN 'on_hold' WHEN 3 THEN 'needless_override' WHEN 4 THEN 'direct_twice' WHEN 5 THEN 'direct_outside' WHEN 6 THEN 'direct_and_irrelevant' WHEN 7 THEN 'direct_of_unanswerable' WHEN 8 THEN 'irrelevant_outside' ELSE '' END AS faults FROM j""")
def m_judgment_rules(t):
    """Reviews of what the search found: approved, overridden, on hold, and one planted fault of each rule by turns."""
    found = hits(t, 10).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("item_id"), "rank")
    k = F.floor(F.col("case_id") / 50) % 9
    lists = found.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    at = lambda i: F.get("ids", F.lit(i))
    two = F.slice("ids", 1, 2)
    direct = F.when(k == 4, F.concat(two, F.array(at(0)))).when(k == 5, F.concat(two, F.array(F.lit(-1).cast("long")))).when(k == 6, F.concat(two, F.array(at(3)))).when(k == 8, F.slice("ids", 1, 0)).otherwise(two)
    irrelevant = F.when(k == 8, F.slice("ids", 6, 1)).otherwise(F.slice("ids", 4, 2))
    verdict = F.when(k == 7, "not_answerable_from_current_corpus").otherwise("answerable")
    judged = F.struct(verdict.alias("verdict"), direct.alias("direct"), irrelevant.alias("irrelevant"))
    other = F.struct(F.lit("answerable").alias("verdict"), F.slice("ids", 1, 0).alias("direct"), F.slice("ids", 1, 0).alias("irrelevant"))
    reviews = lists.select(
        "case_id", F.when(k == 1, other).otherwise(judged).alias("assistant"), F.when(k == 1, judged).when(k == 3, other).alias("override"), F.when(k == 1, "modified").when(k == 2, "on_hold").otherwise("approved").alias("status")
    )
    final = audits.final_judgments(reviews, found)
    return final.select(F.col("case_id").alias("query_id"), "verdict", F.array_join("direct", ",").alias("direct"), F.array_join("faults", ",").alias("faults"))
