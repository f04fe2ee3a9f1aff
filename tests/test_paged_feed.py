"""The paged feed: both formats alike, and every page that isn't what was asked for."""

import json
import tempfile
from pathlib import Path

import pytest

from chronolex.sources import paged_feed as P


def page(kind, number, total, records, wire="JSON", **changes):
    service = {"target": "delHst", "totalCnt": str(total), "page": str(number)} | changes
    rows = [{"일련번호": m, "구분명": P.NAMES[kind], "삭제일자": d} for m, d in records]
    if wire == "JSON":
        return json.dumps({"DataService": service | {"law": rows}})
    inner = "".join(f"<law>{''.join(f'<{k}> {v} </{k}>' for k, v in r.items())}</law>" for r in rows)
    return f"<?xml version='1.0'?><DataService>{''.join(f'<{k}>{v}</{k}>' for k, v in service.items())}{inner}</DataService>"


def folder(pages):
    root = tempfile.mkdtemp(prefix="spark-")
    for (kind, number), body in pages.items():
        at = Path(root) / f"kind={kind}" / f"page={number}"
        at.mkdir(parents=True)
        (at / "body").write_text(body, encoding="utf-8")
    return "file://" + root


MANY = [(str(1000 + k), f"2026{k % 12 + 1:02d}{k % 28 + 1:02d}") for k in range(230)]


def whole(wire):
    return {(1, n + 1): page(1, n + 1, 230, MANY[n * 100 : n * 100 + 100], wire) for n in range(3)}


@pytest.mark.parametrize("wire", ["JSON", "XML"])
def test_all_pages_are_read_each_by_a_task(spark, wire):
    feed = P.read_feed(spark, folder(whole(wire) | {(2, 1): page(2, 1, 0, [], wire)}))
    assert feed.rdd.getNumPartitions() == 4
    assert sorted((r.mst, r.deleted_on.strftime("%Y%m%d")) for r in feed.collect()) == sorted(MANY)
    assert {(r.kind, r.page) for r in feed.select("kind", "page").distinct().collect()} == {(1, 1), (1, 2), (1, 3)}


def test_the_last_of_repeated_records_stays(spark):
    pages = {(1, 1): page(1, 1, 101, [("7", "20260101")] * 99 + [("8", "2026-01-01")]), (1, 2): page(1, 2, 101, [("7", "2026.01.01")])}
    rows = P.deletions(P.read_feed(spark, folder(pages), (1,))).collect()
    assert {(r.mst, r.page) for r in rows} == {("7", 2), ("8", 1)}


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({(1, 2): None}, "missing"),
        ({(1, 1): None}, "no first page"),
        ({(1, 2): page(1, 3, 230, MANY[100:200])}, "says it is page 3"),
        ({(1, 2): page(1, 2, 231, MANY[100:200])}, "231 on page 2"),
        ({(1, 3): page(1, 3, 230, MANY[200:229])}, "29 records, not 30"),
        ({(1, 2): page(2, 2, 230, MANY[100:200])}, "another kind"),
        ({(1, 2): page(1, 2, 230, MANY[100:199] + [("1", "2026")])}, "has no day"),
        ({(1, 2): page(1, 2, 230, MANY[100:200], target="other")}, "another target"),
        ({(1, 2): "{broken"}, "can't be read"),
        ({(1, 2): page(1, 2, 230, MANY[100:200], totalCnt="")}, "lacks its total"),
    ],
)
def test_wrong_pages_end_the_read(spark, change, said):
    pages = {k: v for k, v in (whole("JSON") | change).items() if v is not None}
    with pytest.raises(Exception, match=said):
        P.read_feed(spark, folder(pages), (1,)).collect()
