"""The gold contract over cases made of documents, with one violation of each rule planted by the document's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators import gold
from chronolex.plans.base import query

#: What is planted in documents whose number modulo 97 is k and modulo 4 is one of the kinds: the rules that break.
#: Kinds: 0 fully answerable, 1 partially, 2 to be clarified, 3 unanswerable.
_PLANTED = {
    1: ((0, 1, 2, 3), ("question_hash",)), 2: ((0, 1, 2, 3), ("duplicate_facet",)), 3: ((0, 1), ("unknown_facet",)), 4: ((0, 1), ("not_effective",)), 5: ((0, 1), ("context_missing",)), 6: ((0, 1), ("context_hash",)),
    7: ((0,), ("supported_without_direct", "cites_indirect", "cited_facets_open")), 8: ((1,), ("unsupported_with_direct",)), 9: ((0,), ("precedence",)), 10: ((0, 1, 2, 3), ("action",)), 11: ((2,), ("missing_facts",)),
    12: ((0, 1, 3), ("needless_facts",)), 13: ((1, 3), ("reason_missing",)), 14: ((0, 2), ("needless_reason",)), 15: ((3,), ("unanswerable_with_qrels",)), 16: ((0, 1), ("not_judged", "unclassified")),
    17: ((0, 1), ("distractor_positive",)), 18: ((0, 1, 2, 3), ("unclassified",)), 19: ((0, 1), ("unknown_citation", "cites_indirect")), 20: ((0, 1), ("cites_indirect", "cited_facets_open")),
    21: ((3,), ("unknown_citation", "unanswerable_cites")), 22: ((0, 1, 2, 3), ("pool_methods",)), 23: ((0, 1, 2, 3), ("pool_union",)), 24: ((0, 1, 2, 3), ("duplicate_question",)), 25: ((0, 1), ("duplicate_qrel", "item_twice")), 26: ((0, 1, 2, 3), ("no_facet",)),
}


def _tables(t):
    """The contract's tables; a family is five documents in a row, a control pair the last two of ten."""
    d, kind, k = F.col("doc_id"), F.col("doc_id") % 4, F.col("doc_id") % 97
    on = lambda n: (k == n) & kind.isin(*_PLANTED[n][0])
    docs = t.documents.select("doc_id", "text")
    answered, asks, refuses = kind.isin(0, 1), kind == 2, kind == 3
    question = F.when(on(24), F.lit("the same")).otherwise(F.concat(F.lit("q"), d))
    of = lambda i: F.element_at(F.array(*[F.lit(gold.PRECEDENCE[x][i]) for x in (2, 1, 0, 3)]), (kind + 1).cast("int"))
    paired = (d % 10).isin(8, 9)
    bare = on(26)  # a case without facets counts as unanswerable whatever it was
    cases = docs.select(
        d.alias("case_id"), F.floor(d / 5).alias("family"), F.when(F.floor(d / 5) % 5 == 0, "calibration").otherwise("test").alias("split"), question.alias("question"),
        F.when(on(1), "0").otherwise(F.sha2(question, 256)).alias("question_sha256"), F.lit("2024-06-01").cast("date").alias("as_of"), F.when(on(9), "partially_answerable").when(bare, "unanswerable").otherwise(of(0)).alias("answerability"),
        F.when(on(10), "x").when(bare, "insufficient_evidence").otherwise(of(1)).alias("action"), F.when(on(11) | bare, 0).when(asks | on(12), 1).otherwise(0).alias("n_missing_facts"),
        F.when(on(13) | bare, F.lit(None)).when(kind.isin(1, 3) | on(14), "r").alias("insufficient_reason"), F.when(paired, F.floor(d / 10)).alias("pair_id"), F.when(paired, "answerability_contrast").alias("expectation"),
    )
    status = F.when(answered, "supported").when(asks, "needs_clarification").otherwise("unsupported")
    rows = lambda *some: F.explode(F.filter(F.array(*[F.when(when, F.struct(*[F.lit(v).alias(n) if isinstance(v, (str, int, bool)) else v.alias(n) for n, v in fields.items()])) for when, fields in some]), lambda x: x.isNotNull()))
    facets = docs.where(~bare).select(d.alias("case_id"), rows((F.lit(True), {"facet_id": "f1", "status": status}), (on(2), {"facet_id": "f1", "status": status}), (kind == 1, {"facet_id": "f2", "status": "unsupported"})).alias("r")).select("case_id", "r.*")
    named = F.when(on(3), F.array(F.lit("f1"), F.lit("zz"))).when(on(8), F.array(F.lit("f1"), F.lit("f2"))).otherwise(F.array(F.lit("f1")))
    has = (answered & ~bare) | on(15)
    qrel = {"qrel_id": "q1", "item_id": d * 10 + 1, "relevance": F.when(on(7) | on(15), 1).otherwise(2)}
    qrels = docs.where(has).select(d.alias("case_id"), rows((F.lit(True), qrel), (on(25), qrel)).alias("r"), named.alias("facet_ids"), F.lit("2024-01-01").cast("date").alias("effective_from"), F.when(on(4), F.lit("2024-06-01")).cast("date").alias("effective_to"), F.lit("h").alias("content_sha256"))
    qrels = qrels.select("case_id", "r.*", "facet_ids", "effective_from", "effective_to", "content_sha256")
    contexts = docs.where(has & ~on(5)).select(d.alias("case_id"), F.lit("q1").alias("qrel_id"), F.when(on(6), "g").otherwise("h").alias("content_sha256"))
    judged = docs.select(d.alias("case_id"), rows((has & ~on(16), {"item_id": d * 10 + 1, "distractor": on(17)}), (F.lit(True), {"item_id": d * 10 + 5, "distractor": F.lit(True)}), (on(18), {"item_id": d * 10 + 7, "distractor": F.lit(False)})).alias("r")).select("case_id", "r.*")
    pools = docs.select(d.alias("case_id"), rows((has & ~on(16), {"method": "full", "item_id": d * 10 + 1}), (~on(23), {"method": "full", "item_id": d * 10 + 5}), (on(18), {"method": "full", "item_id": d * 10 + 7}), (on(23), {"method": "full", "item_id": d * 10 + 9}),
        (~on(22) & ~on(23), {"method": "dense", "item_id": d * 10 + 5}), (on(23), {"method": "dense", "item_id": d * 10 + 9})).alias("r")).select("case_id", "r.*")
    citations = docs.select(d.alias("case_id"), rows((answered & ~on(20) & ~bare, {"qrel_id": "q1"}), (on(19) | on(21), {"qrel_id": "q9"})).alias("r")).select("case_id", "r.*")
    return {"cases": cases, "facets": facets, "qrels": qrels, "contexts": contexts, "judged": judged, "pools": pools, "citations": citations}


_BROKEN = ", ".join(f"({k}, {kind}, '{rule}')" for k, (kinds, rules) in _PLANTED.items() for kind in kinds for rule in rules)


@query("m_gold_contract", f"""WITH p(k, kind, rule) AS (VALUES {_BROKEN}), d AS (SELECT doc_id, doc_id // 5 AS family FROM documents)
SELECT rule, CAST(doc_id AS VARCHAR) AS id FROM d JOIN p ON doc_id % 97 = k AND doc_id % 4 = kind WHERE rule <> 'duplicate_question' OR (SELECT count(*) FROM d WHERE doc_id % 97 = 24) > 1
UNION ALL SELECT 'family_size', CAST(family AS VARCHAR) FROM d GROUP BY family HAVING count(*) <> 5 UNION ALL SELECT 'pair_size', CAST(doc_id // 10 AS VARCHAR) FROM d WHERE doc_id % 10 IN (8, 9) GROUP BY doc_id // 10 HAVING count(*) <> 2
UNION ALL SELECT 'no_contrast', CAST(m AS VARCHAR) FROM (SELECT doc_id // 10 AS m, count(DISTINCT CASE WHEN doc_id % 97 = 26 THEN 'unanswerable' WHEN doc_id % 97 = 9 AND doc_id % 4 = 0 THEN 'partially_answerable' ELSE ['fully_answerable', 'partially_answerable', 'clarification_required', 'unanswerable'][doc_id % 4 + 1] END) AS n, count(*) AS c FROM d WHERE doc_id % 10 IN (8, 9) GROUP BY 1) WHERE n < 2 AND c = 2""")
def m_gold_contract(t):
    return gold.violations(_tables(t), ["full", "dense"], 5)


@query("gold_split_assignment", """WITH f AS (SELECT CAST(doc_id // 5 AS VARCHAR) AS family, min(CASE WHEN doc_id // 5 % 5 = 0 THEN 'calibration' ELSE 'test' END) AS split FROM documents GROUP BY 1)
SELECT count(*) AS n_families, sha256('[' || string_agg('["' || family || '","' || split || '"]', ',' ORDER BY family) || ']') AS sha256 FROM f""")
def gold_split_assignment(t):
    return gold.assignment(_tables(t)["cases"])
