import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolex.operators import evaluation, incremental, retrieval, selection, temporal
from chronolex.sources import bundle, parsers
from chronolex.streaming import events as S

D = dt.date


def test_as_of_is_half_open_with_open_ends(spark):
    rows = [(1, D(2020, 1, 1), D(2021, 1, 1)), (2, None, D(2020, 6, 1)), (3, D(2021, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, effective_from date, effective_to date")
    on = lambda d: {r.id for r in df.where(temporal.valid_on(F.lit(d))).collect()}
    assert on(D(2020, 1, 1)) == {1, 2} and on(D(2021, 1, 1)) == {3} and on(D(2020, 12, 31)) == {1}


def test_same_day_versions_share_their_end(spark):
    rows = [(1, 1, D(2020, 1, 1)), (1, 2, D(2020, 1, 1)), (1, 3, D(2020, 5, 1))]
    df = spark.createDataFrame(rows, "document_id int, version_id int, effective_from date")
    got = {r.version_id: r.effective_to for r in temporal.effective_periods(df).collect()}
    assert got == {1: D(2020, 5, 1), 2: D(2020, 5, 1), 3: None}
    assert temporal.conflicting_starts(df).first().n_versions == 2
    pairs = {(r.left_id, r.right_id) for r in temporal.overlaps(temporal.effective_periods(df)).collect()}
    assert pairs == {(1, 2)}


def test_body_root_keeps_whole_paths(spark):
    rows = [(0, 1, "body/p1", 1), (0, 1, "body/p2", 2), (0, 1, "a1/p1", 3), (0, 1, "a1/p2", 4)]
    df = spark.createDataFrame(rows, "q int, document_id int, path string, rank int")
    assert {r.rank for r in temporal.first_per_article(df, ["q"], [F.asc("rank")]).collect()} == {1, 2, 3}


def test_greedy_skips_and_goes_on(spark):
    rows = [(1, 1, "a", 900), (1, 2, "b", 200), (1, 3, "c", 90), (1, 4, "d", 10)]
    df = spark.createDataFrame(rows, "q int, rank int, k string, cost int")
    got = selection.greedy_budget(df, "q", "rank", "cost", "k", 5, 1000).first()
    assert got.chosen == ["a", "c", "d"] and got.used == 1000 and got.budget_exceeded
    first = selection.greedy_budget(df, "q", "rank", "cost", "k", 5, 100).first()
    assert first.chosen == ["a"]
    strict = selection.greedy_budget(df, "q", "rank", "cost", "k", 5, 100, first_exempt=False).first()
    assert strict.chosen == ["c", "d"]


def test_newest_within(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 30), (1, 3, 40)], "c int, turn int, cost int")
    got = selection.newest_within(df, "c", "turn", "cost", 80).collect()
    assert {r.turn for r in got} == {2, 3} and all(r.rolled_over for r in got)


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, item_id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query_id int, item_id string, rank int")
    ab = {r.item_id: r.score for r in retrieval.reciprocal_rank_fusion(a, b).collect()}
    ba = {r.item_id: r.score for r in retrieval.reciprocal_rank_fusion(b, a).collect()}
    assert ab == pytest.approx(ba) and ab["y"] == pytest.approx(1 / 61 + 1 / 62)


def test_equal_scores_fall_by_ninths(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 10, 0.5)], "query_id int, rank int, score double")
    assert [r.normalised for r in retrieval.min_max_by_query(df).orderBy("rank").collect()] == pytest.approx([1.0, 0.0])


def test_keyset_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(10)], "id int, at int")
    seen, cursor = [], None
    while True:
        rows = retrieval.keyset_page(df, "at", "id", cursor, 4).collect()
        seen += [r.id for r in rows[:4]]
        if len(rows) <= 4:
            break
        cursor = (rows[3]["at"], rows[3]["id"])
    assert seen == list(range(9, -1, -1))


def test_near_duplicate_pairs_match_all_pairs(spark):
    texts = ["energy storage law", "energy storage laws", "wind power act", "wind power acts", "", "ab", "energy storage"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def grams(t):
        b = t.replace(" ", "")
        return {b[i : i + 3] for i in range(len(b) - 2)}

    want = {(i, j) for i in range(7) for j in range(i + 1, 7) if grams(texts[i]) and grams(texts[j]) and len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.7}
    got = {(r.left_id, r.right_id) for r in retrieval.near_duplicate_pairs(df, 0.7).collect()}
    assert got == want and want


def test_case_metrics(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "case_id int, item_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "z", 2), (1, "c", 1), (2, "a", 1)], "case_id int, item_id string, grade int")
    got = {r.case_id: r for r in evaluation.case_metrics(ranks, qrels).collect()}
    assert got[1].precision == pytest.approx(0.4) and got[1].recall == pytest.approx(0.5) and got[1].mrr == pytest.approx(0.5)
    assert 0 < got[1].ndcg < 1 and got[2].recall is None and got[2].ndcg == 0 and got[2].hit_rate == 0


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "f int, v double")
    a = evaluation.bootstrap(df, "f", "v", "s", 200).first()
    b = evaluation.bootstrap(df.repartition(3), "f", "v", "s", 200).first()
    assert a == b and a.low <= 2.5 <= a.high


def test_diff_and_quarantine(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "h"), (3, "c", "h")], "id int, text string, heading string")
    new = spark.createDataFrame([(1, "a", None), (2, "B", "h"), (4, "d", "h")], "id int, text string, heading string")
    got = {r.id: (r.state, r.stale_embedding, r.stale_derived) for r in incremental.diff(old, new, "id", ["text", "heading"], ["text"]).collect()}
    assert got == {1: ("unchanged", False, False), 2: ("updated", True, True), 3: ("removed", False, True), 4: ("new", False, False)}


def test_snapshots_are_immutable(spark, tmp_path):
    root = f"file://{tmp_path}"
    incremental.publish(spark.range(3), root, "one")
    incremental.point_to(spark, root, "one")
    with pytest.raises(Exception, match="(?i)already exists"):
        incremental.publish(spark.range(4), root, "one")
    incremental.publish(spark.range(5), root, "two")
    assert incremental.active(spark, root).count() == 3
    incremental.point_to(spark, root, "two")
    assert incremental.active(spark, root).count() == 5


BODY_JSON = """{"source_id": "1", "mst": "2", "title": "T", "effective_from": "2024.01.02", "articles": [
{"number": "1", "title": "Aim", "text": "x", "paragraphs": [{"no": "1", "text": "p", "items": [{"no": "1", "text": "i", "subitems": [{"no": "1", "text": "s"}]}]}]},
{"number": "2", "branch": "3", "text": " y  z "}, {"number": "9", "kind": "chapter", "text": "skip"}, {"number": "1", "text": "again"}]}"""
BODY_XML = """<document><source_id>1</source_id><mst>2</mst><title>T</title><effective_from>2024.01.02</effective_from>
<articles><number>1</number><title>Aim</title><text>x</text><paragraphs><no>1</no><text>p</text><items><no>1</no><text>i</text><subitems><no>1</no><text>s</text></subitems></items></paragraphs></articles>
<articles><number>2</number><branch>3</branch><text> y  z </text></articles><articles><number>9</number><kind>chapter</kind><text>skip</text></articles><articles><number>1</number><text>again</text></articles></document>"""


def test_json_and_xml_give_the_same_tree(spark):
    df = spark.createDataFrame([(1, BODY_JSON), (2, BODY_XML), (3, "neither")], "id int, body string").select("id", parsers.parse_body(F.col("body")).alias("r"))
    rows = parsers.flatten_tree(df.select("id", "r.document")).collect()
    tree = lambda k: sorted((r.ordinal, r.path, r.parent_path, r.heading, r.content) for r in rows if r.id == k)
    assert tree(1) == tree(2)
    assert [r[1] for r in tree(1)] == ["a1", "a1/p1", "a1/p1/i1", "a1/p1/i1/s1", "a2b3"] and tree(1)[4][4] == "y z"
    reasons = {r.id: r.reason for r in df.select("id", "r.reason").collect()}
    assert reasons[1] is None and reasons[2] and reasons[3]
    assert df.where("id = 1").select(parsers.missing_identity(F.col("r.document")).alias("m")).first().m == []


def test_numbered_sections(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(parsers.numbered_sections(F.col("t")).alias("r")).first().r
    assert cut("Intro 1.1 one 1.2 two on 2024.1.2 end") == ["Intro 1.1 one", "1.2 two on 2024.1.2 end"]
    assert cut("only 1.1 here") == ["only 1.1 here"]


def test_rule_paragraphs_and_blocks(spark):
    df = spark.createDataFrame([(1, 0, "Article 3 a"), (1, 1, "x"), (1, 2, "Article 3 b")], "id int, n int, line string")
    assert [r.path for r in parsers.rule_paragraphs(df, "id", "n", "line").orderBy("n").collect()] == ["a3", "body/p2", "a3~2"]
    assert [(r.block, r.n_lines) for r in parsers.text_blocks(df, "id", "n", "line").orderBy("block").collect()] == [(1, 2), (2, 1)]


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert {r.a for r in parsers.read_jsonl_strict(spark, f"{tmp_path}/ok.jsonl", "a int").collect()} == {1, 2}
    with pytest.raises(Exception, match="blank line"):
        parsers.read_jsonl_strict(spark, f"{tmp_path}/bad.jsonl", "a int").collect()


def test_vector_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "v": 1}\n{"id": 2, "v": 1}\n{"id": 1, "v": 9}\n{"id": 3, "v"')
    got = {r.id: r.v for r in parsers.read_vector_cache(spark, f"{tmp_path}/c.jsonl", "id int, v int", "id").collect()}
    assert got == {1: 9, 2: 1}


def test_bundle_detects_changes(spark, tmp_path):
    path = str(tmp_path / "b")
    bundle.write_bundle({"t": spark.range(10)}, {"t": "id"}, f"file://{path}")
    assert bundle.load_bundle(spark, f"file://{path}", {"t": "id long"})["t"].count() == 10
    part = next((tmp_path / "b" / "t").glob("part-*"))
    part.write_text(part.read_text() + '{"id":11}\n')
    for crc in (tmp_path / "b" / "t").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="differ"):
        bundle.load_bundle(spark, f"file://{path}", {"t": "id long"})


def test_executions_match_a_plain_fold(spark, sf_dir):
    got = S.latest(S.run_to_table(S.executions(S.read_events(spark, f"{sf_dir}/events.parquet")), "update"), ["user_id"])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect()
    want = {}
    for r in rows:
        state, n = want.get(r.user_id, ("", 0))
        want[r.user_id] = (S.next_state(state, r.event_type), n + 1)
    assert {r.user_id: (r.state, r.n) for r in got.collect()} == want
