"""Question banks against difflib over all pairs, judgments and sections case by case."""

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronolex.operators import audits
from chronolex.sources import parsers


def grams(text):
    bare = "".join(text.split())
    return {bare[i : i + 3] for i in range(len(bare) - 2)}


def test_near_copies_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    words = "발전소 전기 안전 검사 신청 기한 서류 비용 태양광 풍력 설치 주택 공장 누가 언제 어디".split()
    bank = [" ".join(rng.choice(words) for _ in range(8)) + "?" for _ in range(30)]
    bank += [q.replace(q[i], q[i] + rng.choice(["", "가", "나다"]), 1) for q in bank[:20] for i in (3, 9)]
    bank = list(dict.fromkeys(bank))
    want = set()
    for i, a in enumerate(bank):
        for j, b in enumerate(bank[:i]):
            alike = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if min(len(a), len(b)) / max(len(a), len(b)) >= 0.85 and alike >= 0.6 and (alike >= 0.85 or max(difflib.SequenceMatcher(None, a, b).ratio(), 0) >= 0.92):
                want.add(max(f"{i:03d}", f"{j:03d}"))
    rows = spark.createDataFrame([(f"{k:03d}", q, hashlib.sha256(q.encode()).hexdigest(), "x") for k, q in enumerate(bank)], "id string, question string, question_sha256 string, intent string")
    got = {r.id for r in audits.bank_faults(rows).where("rule = 'near_copy'").collect()}
    assert want and len(want ^ got) <= 1  # a sequence's ratio may depend on the order of the two


def test_faults_of_a_bank(spark):
    said = [(1, "전기 안전 검사는 언제 신청하면 되나요?", None, "a"), (2, "제 3 조를 설명해 주실 수 있을까요?", None, "a"), (3, "짧다?", None, "b"), (4, "물음표가 없는 질문입니다 그렇지요", None, "b"), (5, None, None, "b")]
    rows = spark.createDataFrame([(i, q, h or (hashlib.sha256((q or "").encode()).hexdigest() if i != 1 else "x"), n) for i, q, h, n in said], "id long, question string, question_sha256 string, intent string")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "intent string, n long")
    got = {(r.rule, r.id) for r in audits.bank_faults(rows, expected).collect()}
    assert got == {("hash", "1"), ("forbidden", "2"), ("length", "3"), ("malformed", "4"), ("length", "5"), ("malformed", "5"), ("intent_count", "b"), ("intent_count", "c")}


JUDGED = "struct<verdict:string,direct:array<long>,irrelevant:array<long>>"


@pytest.mark.parametrize(
    ("assistant", "override", "status", "direct", "faults"),
    [
        (("a", [1], [2]), None, "approved", [1], []),
        (("a", [1], [2]), ("b", [3], []), "modified", [3], []),
        (None, None, "approved", None, ["no_review"]),
        (("a", [1], [2]), None, "on_hold", None, ["on_hold"]),
        (("a", [1], [2]), ("b", [], []), "approved", None, ["needless_override"]),
        (("a", [1], [2]), None, "modified", None, ["no_override"]),
        (("a", [1, 1], [2, 2]), None, "approved", [1, 1], ["direct_twice", "irrelevant_twice"]),
        (("a", [99], [6]), None, "approved", [99], ["direct_outside", "irrelevant_outside"]),
        (("a", [1], [1]), None, "approved", [1], ["direct_and_irrelevant"]),
        (("not_answerable_from_current_corpus", [1], []), None, "approved", [1], ["direct_of_unanswerable"]),
    ],
)
def test_which_judgment_counts(spark, assistant, override, status, direct, faults):
    reviews = spark.createDataFrame([(1, assistant, override, status)], f"case_id long, assistant {JUDGED}, override {JUDGED}, status string")
    pool = spark.createDataFrame([(1, k, k) for k in range(1, 12)], "case_id long, item_id long, rank int")
    got = audits.final_judgments(reviews, pool).first()
    assert (got.direct, got.faults) == (direct, faults)


@pytest.mark.parametrize(
    ("text", "sections"),
    [
        ("앞말 1.1 가나 1.2 다라", [("1.1", "앞말 1.1 가나"), ("1.2", "1.2 다라")]),
        ("1.1가나 2024.1.2 다 1.2<b>", [("1.1", "1.1가나 2024.1.2 다"), ("1.2", "1.2<b>")]),
        ("1.1 가나", []),
        ("1.1에서 가 1.2을 나 1.3 및 다 2.1 가", []),
        ("1.1 가 1.2에도 나 10.21 다", [("1.1", "1.1 가 1.2에도 나"), ("10.21", "10.21 다")]),
        ("", []),
    ],
)
def test_numbered_sections(spark, text, sections):
    got = spark.createDataFrame([(text,)], "t string").select(parsers.standard_sections(F.col("t")).alias("s")).first().s
    assert [tuple(s) for s in got] == sections


def test_json_lines(spark, tmp_path):
    (tmp_path / "a").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r.a for r in parsers.read_jsonl(spark, str(tmp_path / "a"), "a int").collect()) == [1, 2]
    (tmp_path / "b").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        parsers.read_jsonl(spark, str(tmp_path / "b"), "a int").collect()
