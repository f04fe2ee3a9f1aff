"""Fixtures that every operator has to stand: nulls, empty and long texts, ties, repeated rows, odd columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word" * 30_000
HARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "the  QUICK brown\tfox jumps over the lazy dog", "en", "b", 45),
    (6, LONG, "en", None, len(LONG)),
    (7, "word " * 20_000, "en", "c", 100_000),
    (8, "Été é́ 😀 日本語 ##</turn>\\", "fr", "c", 20),
    (None, "no id here", "en", "c", 10),
    (9, "x", "en", "a", 1),
]


def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
