"""Figures in words that a claim repeats from its question aren't the claim's."""

from compare import connect, same
from pyspark.sql import functions as F

from chronolex import catalog
from chronolex.operators import evidence


def test_only_what_is_said_besides_has_to_be_carried(spark):
    rows = [("password=5aaa9 93.101.184.67", "", "password 5aaa9 93"), ("x 5 KW", " 허가", "x 5 kw"), (None, " 3.5", "x 3 5"), ("ab cd", "", "xy")]
    df = spark.createDataFrame(rows, "q string, said string, e string")
    judged = df.select(evidence.claim_faults(F.col("said"), F.col("e"), repeated=F.col("q")).alias("f")).collect()
    assert [r.f for r in judged] == [[], ["normative"], ["number"], ["overlap"]]


def test_figures_in_questions(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta 93.101.184.{i} gamma" if i % 50 == 0 else f"alpha beta gamma delta {'password' if i % 3 else ''}", "en", "web", 9) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(catalog.queries()["grounding_text_match"](spark, str(tmp_path)), con, catalog.oracle_sql()["grounding_text_match"])
