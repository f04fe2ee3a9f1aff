"""Rules that a set of judged cases has to meet, as one table of what breaks them.

Facts of each case come from one grouping of each table; which rules a case breaks follows from them in one row. Families,
questions and control pairs are grouped by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<string>"
#: Answerability and action by the states of a case's facets, in this order.
PRECEDENCE = (
    ("clarification_required", "ask_clarifying_question"), ("partially_answerable", "partial_answer_with_limits"), ("fully_answerable", "answer"), ("unanswerable", "insufficient_evidence"),
)
ANSWERED = ("fully_answerable", "partially_answerable")


def _set(c: Column | str) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def case_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of each case with the sets that its rules compare; ids are compared as strings."""
    text = lambda c: F.col(c).cast("string")
    facets = tables["facets"].groupBy("case_id").agg(
        F.count("*").alias("n_facets"), F.collect_set(text("facet_id")).alias("facets"), *[F.collect_set(F.when(F.col("status") == s, text("facet_id"))).alias(s) for s in ("supported", "unsupported", "needs_clarification")]
    )
    cited = tables["citations"].select("case_id", text("qrel_id").alias("qrel_id")).distinct().withColumn("cited", F.lit(True))
    contexts = tables["contexts"].groupBy("case_id", text("qrel_id").alias("qrel_id")).agg(F.count("*").alias("n_contexts"), F.min("content_sha256").alias("context_sha256"))
    qrels = tables["qrels"].withColumn("qrel_id", text("qrel_id")).withColumn("item_id", text("item_id")).join(tables["cases"].select("case_id", "as_of"), "case_id")
    qrels = qrels.join(contexts, ["case_id", "qrel_id"], "left").join(cited, ["case_id", "qrel_id"], "left").withColumn("facet_ids", F.col("facet_ids").cast(_NONE))
    direct, late = F.col("relevance") == 2, (F.col("as_of") < F.col("effective_from")) | (F.coalesce(F.col("as_of") >= F.col("effective_to"), F.lit(False)))
    flat = lambda when: F.array_distinct(F.flatten(F.collect_list(F.when(when, F.col("facet_ids")))))
    of_qrels = qrels.groupBy("case_id").agg(
        F.count("*").alias("n_qrels"), F.collect_set("qrel_id").alias("qrel_ids"), F.collect_set("item_id").alias("qrel_items"), F.collect_set(F.when(direct, F.col("qrel_id"))).alias("direct_ids"), flat(F.lit(True)).alias("named"),
        flat(direct).alias("direct_facets"), flat(direct & F.col("cited")).alias("cited_facets"), F.bool_or(late).alias("late"), F.bool_or(F.coalesce(F.col("n_contexts") != 1, F.lit(True))).alias("context_missing"),
        F.bool_or(F.coalesce(F.col("context_sha256") != F.col("content_sha256"), F.lit(False))).alias("context_differs"),
    )
    judged = tables["judged"].groupBy("case_id").agg(F.collect_set(text("item_id")).alias("judged"), F.collect_set(F.when(F.col("distractor"), text("item_id"))).alias("distractors"))
    pools = tables["pools"].groupBy("case_id").agg(F.collect_set(text("item_id")).alias("pooled"), F.collect_set("method").alias("methods"))
    citations = cited.groupBy("case_id").agg(F.collect_set("qrel_id").alias("cited"))
    out = tables["cases"]
    for part in (facets, of_qrels, judged, pools, citations):
        out = out.join(part, "case_id", "left")
    return out


def case_rules(methods: list[str]) -> dict[str, Column]:
    """Rule by rule, whether a row of ``case_facts`` breaks it."""
    s = {c: _set(c) for c in ("facets", "supported", "unsupported", "needs_clarification", "qrel_ids", "qrel_items", "direct_ids", "named", "direct_facets", "cited_facets", "judged", "distractors", "pooled", "methods", "cited")}
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    alike = lambda a, b: within(a, b) & within(b, a)
    some = lambda c: F.size(s[c]) > 0
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    wanted = [F.when(some("needs_clarification"), F.lit(0)).when(some("supported") & some("unsupported"), F.lit(1)).when(some("supported"), F.lit(2)).otherwise(F.lit(3))]
    of = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PRECEDENCE]), wanted[0] + 1)
    answered = F.col("answerability").isin(*ANSWERED)
    asks, refuses = F.col("answerability") == PRECEDENCE[0][0], F.col("answerability") == PRECEDENCE[3][0]
    facts, reason = F.coalesce("n_missing_facts", F.lit(0)), F.col("insufficient_reason").isNotNull()
    return {
        "pair_half": F.col("pair_id").isNull() != F.col("expectation").isNull(), "question_hash": ~F.col("question_sha256").eqNullSafe(F.sha2("question", 256)),
        "duplicate_facet": F.coalesce("n_facets", F.lit(0)) != F.size(s["facets"]), "no_facet": ~some("facets"), "duplicate_qrel": F.coalesce("n_qrels", F.lit(0)) != F.size(s["qrel_ids"]),
        "item_twice": F.coalesce("n_qrels", F.lit(0)) != F.size(s["qrel_items"]), "unknown_facet": ~within(s["named"], s["facets"]), "not_effective": no("late"), "context_missing": no("context_missing"), "context_hash": no("context_differs"),
        "supported_without_direct": ~within(s["supported"], s["direct_facets"]), "unsupported_with_direct": F.arrays_overlap(s["unsupported"], s["direct_facets"]),
        "precedence": F.col("answerability") != of(0), "action": F.col("action") != of(1), "missing_facts": asks & (facts == 0), "needless_facts": ~asks & (facts > 0),
        "reason_missing": some("unsupported") & ~reason, "needless_reason": ~some("unsupported") & reason, "unanswerable_with_qrels": refuses & some("qrel_ids"), "not_judged": ~within(s["qrel_items"], s["judged"]),
        "distractor_positive": F.arrays_overlap(s["qrel_items"], s["distractors"]), "unclassified": ~alike(F.array_union(s["qrel_items"], s["distractors"]), s["judged"]), "unknown_citation": ~within(s["cited"], s["qrel_ids"]),
        "cites_indirect": answered & (~some("cited") | ~within(s["cited"], s["direct_ids"])), "cited_facets_open": answered & ~within(s["supported"], s["cited_facets"]), "unanswerable_cites": refuses & some("cited"),
        "pool_methods": ~alike(s["methods"], F.array(*[F.lit(m) for m in methods])), "pool_union": ~alike(s["pooled"], s["judged"]),
    }


def violations(tables: dict[str, DataFrame], methods: list[str], family_size: int) -> DataFrame:
    """(rule, id) of everything that breaks a rule: the id is a case's, a family's or a control pair's, as a string.

    ``tables``: cases (case_id, family, split, question, question_sha256, as_of, answerability, action, n_missing_facts,
    insufficient_reason, pair_id, expectation), facets (case_id, facet_id, status), qrels (case_id, qrel_id, item_id,
    relevance, facet_ids, effective_from, effective_to, content_sha256), contexts (case_id, qrel_id, content_sha256), judged
    (case_id, item_id, distractor), pools (case_id, method, item_id), citations (case_id, qrel_id). Empty tables are allowed.
    """
    facts = case_facts(tables)
    rules = case_rules(methods)
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]), lambda x: x.isNotNull())
    by_case = facts.select(F.explode(broken).alias("rule"), F.col("case_id").cast("string").alias("id"))
    cases = tables["cases"]
    named = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
    asked = cases.groupBy("question").agg(F.count("*").alias("n"), F.collect_list("case_id").alias("ids")).where("n > 1").select(F.explode("ids").alias("case_id"))
    families = cases.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    pairs = facts.where("pair_id is not null").groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_distinct("expectation").alias("expectations"), F.min("expectation").alias("expectation"), F.count_distinct("answerability").alias("kinds"),
        F.min_by(_set("direct_ids"), "case_id").alias("a"), F.max_by(_set("direct_ids"), "case_id").alias("b"),
    )
    two = (F.col("n") == 2) & (F.col("expectations") == 1)
    shares = F.arrays_overlap("a", "b")
    return (
        by_case.unionByName(named(asked, "duplicate_question", "case_id")).unionByName(named(families.where("splits > 1"), "family_split", "family")).unionByName(named(families.where(F.col("n") != family_size), "family_size", "family"))
        .unionByName(named(pairs.where("n <> 2"), "pair_size", "pair_id")).unionByName(named(pairs.where("splits > 1"), "pair_split", "pair_id")).unionByName(named(pairs.where("expectations > 1"), "pair_expectation", "pair_id"))
        .unionByName(named(pairs.where(two & (F.col("expectation") == "same_direct_evidence") & ~((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0))), "same_evidence", "pair_id"))
        .unionByName(named(pairs.where(two & (F.col("expectation") == "different_direct_evidence") & shares), "different_evidence", "pair_id"))
        .unionByName(named(pairs.where(two & (F.col("expectation") == "answerability_contrast") & (F.col("kinds") < 2)), "no_contrast", "pair_id"))
    )


def assignment(cases: DataFrame) -> DataFrame:
    """n_families and the SHA-256 over the JSON array of [family, split] in order, which the manifest of the split holds.

    Families are a bounded evaluation table: their names make one value.
    """
    families = cases.groupBy(F.col("family").cast("string").alias("family")).agg(F.min("split").alias("split"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("family", "split"))), lambda x: F.concat(F.lit('["'), x["family"], F.lit('","'), x["split"], F.lit('"]'))), ",")
    return families.agg(F.count("*").alias("n_families"), F.sha2(F.concat(F.lit("["), line, F.lit("]")), 256).alias("sha256"))
