from types import SimpleNamespace

from chronolex.plans.aggregates import agg_citation_quality


def test_a_shared_opening_is_no_quote(spark):
    passage = "The passage begins with these words, which many texts share, and ends in its own way."
    docs = spark.createDataFrame([(5, passage[:50] + " and then differs"), (10, f"before {passage} after")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, passage), (3, passage), (4, "short")], "item_id long, text string")
    assert tuple(agg_citation_quality(SimpleNamespace(documents=docs, benchmark=bench)).first()) == (0.5, 0.25)
