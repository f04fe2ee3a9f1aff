"""Queries that need the search's result more than once run the search once; lengths of articles need no articles."""

import pytest
from test_plans import plan

from chronolex import catalog
from chronolex.operators import selection
from chronolex.plans.aggregates import hits
from chronolex.plans.base import Tables


@pytest.mark.parametrize("name", ["q_context_assembly", "agg_combo_report", "q_agent_graph", "m_control_pairs"])
def test_one_search(spark, sf_dir, name):
    tree = plan(catalog.queries()[name](spark, sf_dir)).split("\n\n")[0]
    assert tree.count("FlatMapCoGroupsInArrow") == 1


def test_whole_articles_under_a_budget(spark, sf_dir):
    t = Tables(spark, sf_dir)
    texts = selection.subtree_text(t.provisions, ["doc_id"], "ordinal", "content").selectExpr("doc_id AS vec_id", "length(text) AS chars")
    want = selection.greedy_budget(hits(t).join(texts, "vec_id"), "query_id", "rank", "chars", "vec_id", 3, 9000, first_exempt=False)
    got = catalog.queries()["greedy_budget_variant_b"](spark, sf_dir)
    gathers = "collect_list(struct(o, ordinal"
    assert gathers in plan(want) and gathers not in plan(got)
    assert sorted((r.query_id, r.used, r.chosen, r.budget_exceeded) for r in got.collect()) == sorted((r.query_id, r.used, ",".join(map(str, r.chosen)), r.budget_exceeded) for r in want.collect())
