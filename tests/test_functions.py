import hashlib
import unicodedata
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.functions import text as X
from chronolex.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def test_compact_date(spark):
    for given, want in (("2024. 1. 05", None), ("2024-01-05", "2024-01-05"), ("20240230", None), ("", None)):
        got = one(spark, X.compact_date(F.col("c")), c=given)
        assert (str(got) if got else None) == want


def test_passage_trims_and_skips(spark):
    assert one(spark, X.passage(F.col("a"), F.col("b"), F.lit(None).cast("string")), a=" t ", b="  ") == "t"
    assert one(spark, X.passage(F.col("a"), F.col("b"), trim=False), a=" t ", b="") == " t "


def test_strip_endings_takes_first_that_leaves_two(spark):
    assert one(spark, X.strip_endings(F.col("w"), ("ings", "s")), w="things") == "th"
    assert one(spark, X.strip_endings(F.col("w"), ("ings", "s")), w="ings") == "ing"
    assert one(spark, X.strip_endings(F.col("w"), ("abc",)), w="abcd") == "abcd"


def test_terms_are_first_five_distinct(spark):
    got = one(spark, X.terms(F.col("t"), stop=("the",)), t="The a bb cc BB dd ee ff gg")
    assert got == ["bb", "cc", "dd", "ee", "ff"]


def test_aliases_once(spark):
    assert one(spark, X.expand_aliases(F.array(F.lit("a"), F.lit("b")), {"a": ["b", "c"]})) == ["a", "b", "c"]


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard(empty, empty)) == 1.0
    assert one(spark, X.jaccard(X.trigrams(F.lit("abcd")), X.trigrams(F.lit("abce")))) == pytest.approx(1 / 3)


def test_token_estimate(spark):
    assert one(spark, X.token_estimate(F.col("t")), t="abcd éé x") == 2 + 2 + 1


def test_approximate_tokens_rounds_to_even(spark):
    for n in (0, 1, 11, 33, 1000):
        assert one(spark, X.approximate_tokens(F.lit(n))) == round(n / 2.2)


def test_allowed_url(spark):
    ok = X.allowed_url(F.col("u"), ("example.com",))
    for u, want in (("https://example.com/a", True), ("https://x.example.com:443", True), ("https://a@example.com/", False), ("http://example.com", False), ("https://example.com:8443/", False), ("https://badexample.com", False)):
        assert one(spark, ok, u=u) is want


def test_nfkc_and_ratio(spark):
    t = "ﬁ ＡＢ ẞ"
    assert one(spark, X.nfkc_casefold(F.col("t")), t=t) == unicodedata.normalize("NFKC", t).casefold()
    assert one(spark, X.sequence_ratio("a", "b"), a="private", b="primate") == SequenceMatcher(None, "private", "primate").ratio()


def test_uuid5(spark):
    ns = uuid.uuid4()
    for name in ("x", "é/1", ""):
        assert one(spark, H.uuid5(ns, F.col("n")), n=name) == str(uuid.uuid5(ns, name))


def test_modulo_split_and_draw(spark):
    for k in ("a", "bb", "ccc"):
        h = int(hashlib.sha256(k.encode()).hexdigest(), 16)
        assert one(spark, H.modulo_split(F.col("k"), 5), k=k) == h % 5
        assert one(spark, H.draw(F.col("k"), F.lit(37)), k=k) == int(hashlib.sha256(k.encode()).hexdigest()[:16], 16) % 37
    with pytest.raises(ValueError):
        H.modulo_split(F.lit("a"), 7)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 3)
    a = H.ordered_fingerprint(df, "id", F.col("v").cast("string")).first()
    b = H.ordered_fingerprint(df.orderBy(F.desc("id")).repartition(7), "id", F.col("v").cast("string")).first()
    assert a == b
    m = H.merkle_fingerprint(df, "id", F.col("v").cast("string")).first()
    assert m == H.merkle_fingerprint(df.repartition(9), "id", F.col("v").cast("string")).first()


def test_canonical_ip(spark):
    for given, want in (("::ffff:10.0.0.1", "10.0.0.1"), ("2001:0db8::0001", "2001:db8::1"), ("x", None)):
        assert one(spark, H.canonical_ip("a"), a=given) == want


def test_cosine_edges(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, V.cosine(v(1, 0), v(0, 2))) == 0
    assert one(spark, V.cosine(v(0, 0), v(0, 2))) is None
    assert one(spark, V.cosine(v(3, 4), v(3, 4))) == pytest.approx(1.0)
    assert one(spark, V.is_finite(v(1, float("nan")))) is False
    assert one(spark, V.parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5]


def test_compact_text_folds_and_keeps_hangul(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ ①번, 제3조! Ａ-b",), (None,)], "t string")
    assert [r.c for r in df.select(X.compact_text(F.col("t")).alias("c")).collect()] == ["full1번제3조ab", None]
