"""Cases at the edge that whole runs met: very long joined words, names with dots, rows that differ in a payload alone."""

import pytest
from helpers import hard
from pyspark.sql import functions as F

import corpus_pipeline
from chronolex.llm import mixing, quality_fm, secret_scan, token_count

KEY = "Zk7xQ9vLp2Rt8Wb4Nf6Hd1"


@pytest.mark.parametrize("sign", ["/", "_", "-"])
def test_a_megabyte_of_joined_words_is_scanned(spark, sign):
    text = sign.join(["ab", "12"] * 170_000) + " " + KEY
    got = secret_scan.digest(secret_scan.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert len(text) > 1_000_000 and got.spans == f"entropy:{len(text) - len(KEY)}:{len(text)}"


def test_joined_words(spark):
    words = {"ab/12/cd": True, "/usr/local/lib/": True, "ab": False, "ab--cd": False, "a-b-c": False, "ab-123456789": False, "//ab/cd": False, "ab/cd//": False, "ab_12-cd": True, "-ab-cd": False}
    rows = spark.createDataFrame(list(words.items()), "w string, said boolean").select("w", "said", secret_scan.joined(F.col("w")).alias("got"))
    assert all(r.got == r.said for r in rows.collect())


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_stand_names_with_dots(spark, sf_dir, stage):
    docs = hard(spark).withColumn("a.b", F.lit(1)).withColumn("own.text", F.col("text"))
    got = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() > 0


def test_mixing_takes_the_same_of_rows_that_differ_in_a_payload(spark):
    rows = [(1, "one two three", "a", k) for k in range(300)] + [(2, "x y", "b", 0)] * 900
    sums = set()
    for parts in (1, 2, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `pay.load` long").repartition(parts)
        got = mixing.repeated(docs)
        sums.add(got.agg(F.count("*"), F.sum("`pay.load`"), F.sum(F.col("`pay.load`") * F.col("`pay.load`"))).first())
    assert len(sums) == 1


def test_quality_of_any_id_and_length(spark):
    rows = [(f"d{k}", "good text here" if k % 2 else "bad bad", float("nan") if k % 3 else float("inf")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_chars double")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(60)], "doc_id string, quality int")
    got = quality_fm.quality(docs, labels).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 and isinstance(r.doc_id, str) for r in got)


def test_long_pretokens_are_not_remembered():
    bpe = token_count.Bpe(token_count.default_vocabulary())
    assert bpe.count(["a" * 5000 + " b", "a" * 5000]) == [bpe.count(["a" * 5000])[0] + 1, bpe.count(["a" * 5000])[0]]
    assert max(map(len, bpe.seen)) <= token_count.LONG
