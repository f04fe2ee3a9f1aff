"""Activation rules on single documents: the first broken rule, and the state read off the raw body."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from chronolex.operators import activation

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
VERSION = "version_id long, title string, source_id string, mst string, effective_from string, parser_version string, source_kind string, raw_format string, wire_format string, raw_sha256 string, body string"
TREE = [("제1조", None, "a"), ("제1조/항1", "제1조", "b"), ("제2조의2", None, "c")]


def named(path, kind="law"):
    fields = {"effective_from": "2024-01-01", "mst": "7", "path": path, "source_id": "s", "source_kind": kind}
    return str(uuid.uuid5(SPACE, json.dumps(fields, ensure_ascii=False, separators=(",", ":"))))


def judge(spark, body="{}", tree=TREE, kind="law", wire="JSON", ids=named, **changes):
    row = {"version_id": 1, "title": "t", "source_id": "s", "mst": "7", "effective_from": "2024-01-01", "parser_version": "3", "source_kind": kind, "raw_format": wire.lower(), "wire_format": wire, "raw_sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body}
    versions = spark.createDataFrame([tuple((row | changes).values())], VERSION).withColumn("effective_from", F.to_date("effective_from"))
    nodes = spark.createDataFrame([(1, p, parent, c, ids(p, kind)) for p, parent, c in tree], "version_id long, path string, parent_path string, content string, provision_id string")
    return activation.activation(versions, nodes, F.lit("2024-06-01").cast("date"), "3", SPACE).first()


def test_a_sound_version_is_active(spark):
    got = judge(spark)
    assert (got.problem, got.lifecycle_state, got.record_state, got.has_supplementary) == (None, "active", "available", False)


@pytest.mark.parametrize(
    ("tree", "problem"),
    [
        ([], "no_provisions"),
        ([*TREE, TREE[1]], "duplicate_path"),
        ([("제1조", None, " \n ")], "empty_content"),
        ([("제1조", None, "a"), ("제1조/항1", "제1조/항9", "b")], "parent_absent"),
        ([("body/1", None, "a")], "not_an_article"),
        ([("제1조", None, "a"), ("제1조/항1", None, "b")], "no_parent_path"),
        ([("제1조", None, "제1장 총칙")], "structure_marker"),
        ([("제1조", None, "a"), ("제2조", None, "a"), ("제2조/항1", "제1조", "b")], "parent_elsewhere"),
        ([("제1조/항1", "제1조/항1", "b")], "article_root_absent"),
    ],
)
def test_rules_on_the_tree(spark, tree, problem):
    assert judge(spark, tree=tree).problem == problem


def test_trees_of_other_kinds_only_need_their_parents(spark):
    assert judge(spark, tree=[("body/1", None, "제1장")], kind="rule").problem is None


def test_rules_on_the_record(spark):
    assert judge(spark, ids=lambda p, kind: "x").problem == "provision_id"
    assert judge(spark, title=None).problem == "no_title"
    assert judge(spark, raw_sha256=None).problem == "raw_sha256"
    assert judge(spark, title="", tree=[]).problem == "no_title"  # the first rule counts


def test_markers_of_both_formats(spark):
    body = '{"a":{"폐지일자":"20230101","자치삭제여부":"Y"},"부칙":[]}'
    got = judge(spark, body)
    assert (got.lifecycle_state, got.record_state, got.has_supplementary) == ("abolished", "deleted", True)
    got = judge(spark, "<r><폐지여부>Y</폐지여부><부칙 n='1'/></r>", wire="XML")
    assert (got.lifecycle_state, got.record_state, got.has_supplementary) == ("abolished", "available", True)
    got = judge(spark, '{"폐지여부":"N","폐지일":"","삭제여부":"0"}')
    assert (got.lifecycle_state, got.record_state) == ("active", "available")


@pytest.mark.parametrize(
    ("body", "wire", "state", "record", "supplementary"),
    [
        ('{"폐지일자":0}', "JSON", "active", "available", False),
        ('{"폐지일자":false,"폐지일":null,"x":[{"폐지일":[1]}]}', "JSON", "active", "available", False),
        ('{"\\ud3d0\\uc9c0\\uc5ec\\ubd80":"Y"}', "JSON", "abolished", "available", False),
        ('<r><폐지여부 k="1">Y</폐지여부></r>', "XML", "abolished", "available", False),
        ("<r><부칙/></r>", "XML", "active", "available", True),
        ("<r><a><b><c:삭제여부 xmlns:c='u'><d>예</d></c:삭제여부></b></a></r>", "XML", "active", "deleted", False),
        ('{"a":[[{"b":{"폐지여부":true}}]]}', "JSON", "abolished", "available", False),
        ("<r><폐지일자> <x>2020</x></폐지일자></r>", "XML", "abolished", "available", False),
    ],
)
def test_marks_are_read_off_the_parsed_body(spark, body, wire, state, record, supplementary):
    got = judge(spark, body, wire=wire)
    assert (got.problem, got.lifecycle_state, got.record_state, got.has_supplementary) == (None, state, record, supplementary)


@pytest.mark.parametrize(("body", "wire"), [("{broken", "JSON"), ("<r>", "XML"), ("{}", "XML"), ("<!DOCTYPE r [<!ENTITY a 'b'>]><r/>", "XML"), ("[" * 100_000, "JSON")])
def test_unreadable_bodies_are_refused(spark, body, wire):
    got = judge(spark, body, wire=wire)
    assert (got.problem, got.lifecycle_state) == ("unreadable", None)


def test_structure_signs_end_where_the_rule_says(spark):
    for content, problem in (("제3절차에 따라 신청한다", None), ("제 3 절", "structure_marker"), ("제3장의2 보칙", "structure_marker"), ("제1편 총칙", None), ("제1관", None)):
        assert judge(spark, tree=[("제1조", None, content)]).problem == problem
