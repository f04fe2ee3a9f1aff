from pyspark.sql import functions as F

from chronolex.functions import references as R


def parse(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(R.with_arabic_numbers("t").alias("q"))
    return df.select(R.references(F.col("q")).alias("r")).first().r


def test_forms(spark):
    for text, want in (
        ("1조2항", ["제1조/항2"]), ("제 3 조의 2 제1항 제4호 가목", ["제3조의2/항1/호4/목가"]), ("제이십오조 ③항", ["제25조/항3"]), ("제1조 제2항 및 제3항", ["제1조/항2", "제1조/항3"]),
        ("제7조, 제9조와 제7조", ["제7조", "제9조"]), ("no reference", []), (None, []),
        ("12조의3제4호를 위반하면", ["제12조의3/호4"]), ("제2항만 물어봄", []), ("제4조는 제2항과 다르다", ["제4조"]), ("제5조 제1항, 제2항 또는 제3항", ["제5조/항1", "제5조/항2", "제5조/항3"]),
        ("제5조의2 제1항 및 제9조 제2호 나목", ["제5조의2/항1", "제9조/호2/목나"]), ("제007조", ["제7조"]), ("제8조 제십일항 제이호", ["제8조/항11/호2"]), ("전화 02-123, 3층 제1조", ["제1조"]),
    ):
        assert parse(spark, text).paths == want, text


def test_ranges(spark):
    assert parse(spark, "제3조부터 제5조까지").paths == ["제3조", "제4조", "제5조"]
    assert parse(spark, "제5조부터 제3조까지").invalid == "descending_range"
    assert parse(spark, "제1조부터 제21조까지").invalid == "range_too_wide"
    assert len(parse(spark, "제1조부터 제20조까지").paths) == 20


def test_numerals():
    for word, n in (("영", 0), ("십", 10), ("이십오", 25), ("백", 100), ("백일", 101), ("삼백이십일", 321), ("일이", None), ("", None), ("x", None)):
        assert R.korean_number(word) == n


def test_variants(spark):
    got = spark.range(1).select(R.storage_variants(F.lit("제3조의2/항1/호4/목가")).alias("a"), R.storage_variants(F.lit("제3조/항21")).alias("b"), R.storage_variants(F.lit("제3조")).alias("c")).first()
    assert got.a == sorted(["제3조의2/항1/호4/목가", "제3조의2/항①/호4./목가."]) and got.b == ["제3조/항21"] and got.c == ["제3조"]
