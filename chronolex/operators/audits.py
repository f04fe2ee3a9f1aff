"""Audits of question banks and of reviewed judgments: each names what breaks which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.retrieval import near_duplicate_pairs

# Fixed values of the specified audit: what a question must not say, and how long it may be.
FORBIDDEN = (r"제\s*\d+\s*(?:조|항|호|목)", r"(?:조문|직접\s+정한\s+내용|규정에서)", r"(?:전기사업법|전기안전관리법|분산에너지\s+활성화\s+특별법)")
LENGTH = (15, 120)
#: Near copies: lengths within the ratio, and trigrams alike by the first bound, or by the second with a like sequence.
RATIO, ALIKE, MAYBE, SEQUENCE = 0.85, 0.85, 0.60, 0.92


def _of(rules: dict[str, Column], key: str) -> Column:
    """array<string> of the names of the rules that hold."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def bank_faults(questions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(rule, id) of ``questions`` (id, question, question_sha256, intent): forbidden words, length, form, hash, repeats, near copies.

    ``expected`` (intent, n) adds ``intent_count`` rows for intents of another number. Texts are compared with single spaces.
    Near copies name the later question of a pair.
    """
    from chronolex.functions.text import collapse_whitespace, sequence_ratio

    said = F.coalesce("question", F.lit(""))
    plain = collapse_whitespace(said)
    says = F.lit(False)
    for pattern in FORBIDDEN:
        says = says | said.rlike(pattern)
    rules = {
        "forbidden": says, "length": ~F.length(plain).between(*LENGTH), "malformed": ~said.endswith("?") | F.contains(said, F.lit("{")) | F.contains(said, F.lit("}")), "hash": ~F.col("question_sha256").eqNullSafe(F.sha2(said, 256)),
    }
    texts = questions.select(F.col("id").cast("string").alias("id"), plain.alias("text"))
    out = questions.select(F.explode(_of(rules, "id")).alias("rule"), F.col("id").cast("string").alias("id"))
    again = texts.groupBy("text").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select(F.lit("repeated").alias("rule"), F.explode("ids").alias("id"))
    # one question stands for its repeats; pairs are formed among different texts alone
    one = texts.groupBy("text").agg(F.min("id").alias("id"))
    pairs = near_duplicate_pairs(one, MAYBE)
    of = lambda side, name: one.select(F.col("id").alias(side), F.col("text").alias(name))
    both = pairs.join(of("left_id", "a"), "left_id").join(of("right_id", "b"), "right_id").where(F.least(F.length("a"), F.length("b")) >= F.greatest(F.length("a"), F.length("b")) * RATIO)
    near = both.where((F.col("similarity") >= ALIKE) | (sequence_ratio("a", "b") >= SEQUENCE)).select(F.lit("near_copy").alias("rule"), F.greatest("left_id", "right_id").alias("id")).distinct()
    out = out.unionByName(again).unionByName(near)
    if expected is not None:
        counts = questions.groupBy("intent").agg(F.count("*").alias("found")).join(expected, "intent", "full")
        wrong = counts.where(~F.coalesce("found", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0).cast("long"))))
        out = out.unionByName(wrong.select(F.lit("intent_count").alias("rule"), F.col("intent").cast("string").alias("id")))
    return out


def final_judgments(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, verdict, direct, irrelevant and faults: the judgment that counts of each reviewed case.

    ``reviews``: case_id, assistant and override (each struct<verdict, direct: array, irrelevant: array>, null if there is
    none) and status (approved, modified, on_hold). An approved review counts as the assistant gave it, a modified one by its
    override. ``candidates`` (case_id, item_id, rank): direct evidence has to be among the first ten, irrelevant among the
    first five. Without a judgment that counts its columns are null.
    """
    pool = candidates.where("rank <= 10").groupBy("case_id").agg(F.collect_set("item_id").alias("ten"), F.collect_set(F.when(F.col("rank") <= 5, F.col("item_id"))).alias("five"))
    rows = reviews.join(pool, "case_id", "left")
    status, given = F.col("status"), F.col("override").isNotNull()
    counts = F.when(F.col("assistant").isNull() | (status == "on_hold"), F.lit(None)).when(status == "approved", F.when(~given, F.col("assistant"))).otherwise(F.col("override"))
    rows = rows.withColumn("final", counts)
    direct, irrelevant = F.col("final.direct"), F.col("final.irrelevant")
    none = F.array().cast(candidates.select(F.collect_set("item_id")).schema[0].dataType.simpleString())
    ten, five = F.coalesce("ten", none), F.coalesce("five", none)
    twice = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    rules = {
        "no_review": F.col("assistant").isNull(), "on_hold": F.col("assistant").isNotNull() & (status == "on_hold"), "needless_override": (status == "approved") & given, "no_override": (status == "modified") & ~given,
        "direct_twice": twice(direct), "irrelevant_twice": twice(irrelevant), "direct_outside": F.size(F.array_except(direct, ten)) > 0, "irrelevant_outside": F.size(F.array_except(irrelevant, five)) > 0,
        "direct_and_irrelevant": F.arrays_overlap(direct, irrelevant), "direct_of_unanswerable": (F.col("final.verdict") == "not_answerable_from_current_corpus") & (F.size(direct) > 0),
    }
    return rows.select("case_id", "final.verdict", "final.direct", "final.irrelevant", _of(rules, "case_id").alias("faults"))
