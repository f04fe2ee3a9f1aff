"""Plan shapes that large inputs depend on."""

import io
from contextlib import redirect_stdout

from chronolex import catalog


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.queries()["filter_source_kind"](spark, sf_dir))
    assert "PushedFilters: [In(source" in text and "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_topk_cuts_groups_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(catalog.queries()["topk_dense_exact"](spark, sf_dir))


def test_global_topk_is_no_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["filter_prefilter_v2"](spark, sf_dir))


def test_history_join_is_an_equi_join(spark, sf_dir):
    text = plan(catalog.queries()["join_overlap_self"](spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_python_in_native_queries(spark, sf_dir):
    for name in ("q_four_stage_cascade", "agg_case_metrics", "join_near_duplicates", "window_effective_periods", "read_compact_json"):
        text = plan(catalog.queries()[name](spark, sf_dir))
        assert not any(word in text for word in ("Python", "Pandas", "Arrow")), name
