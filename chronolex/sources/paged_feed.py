"""A feed of deleted records as a Spark data source: a partition is a page, and a page has to be what was asked for.

``spark.read.format("paged_feed").option("folder", uri).option("kinds", "1,2")`` asks each kind's first page how many records
there are, and every further page is read by a task of its own. Pages lie under ``kind=<k>/page=<p>/`` of a folder
of any file system that pyarrow reaches; another place needs another ``fetch``.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolex.sources import trees

# Fixed values of the feed: fields, targets, names of the kinds, records on a page.
TOTAL, PAGE, TARGET, NUMBER, NAME, DAY = "totalCnt", "page", "target", "일련번호", "구분명", "삭제일자"
TARGETS = ("delHst", "datDel")
NAMES = {1: "법령", 2: "행정규칙"}
SIZE = 100


class FeedError(ValueError):
    """A page that isn't what was asked for."""


def fetch(folder: str, kind: int, page: int) -> str | None:
    """The body of one page, or None if there is no such page."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(f"{path}/kind={kind}/page={page}", allow_not_found=True))
    files = sorted(f.path for f in found if re.match(r"part-|body", f.base_name))
    if not files:
        return None
    with system.open_input_file(files[0]) as f:
        return f.read().decode("utf-8")


def parse_page(body: str, kind: int, page: int) -> tuple[int, list[tuple[str, str, datetime.date]]]:
    """The feed's total and the records (number, kind name, day) of one page in either format, checked."""
    try:
        nodes = trees.xml_nodes(body, re.compile(".")) if body.lstrip("\ufeff\r\n\t ").startswith("<") else trees.json_nodes(body)
    except (ValueError, SyntaxError, RecursionError) as e:
        raise FeedError(f"page {page} of kind {kind} can't be read") from e
    texts: dict[str, str] = {}
    records: dict[int, dict[str, str]] = {}
    for parent, name, _, _, text in nodes:
        if name and text:
            texts.setdefault(name, text)
        if name in (NUMBER, NAME, DAY):
            records.setdefault(parent, {})[name] = text
    if texts.get(TARGET) not in TARGETS:
        raise FeedError(f"page {page} of kind {kind} is of another target: {texts.get(TARGET)}")
    if TOTAL not in texts or PAGE not in texts:
        raise FeedError(f"page {page} of kind {kind} lacks its total or its number")
    total = int(texts[TOTAL])
    if total and int(texts[PAGE]) != page:
        raise FeedError(f"page {page} of kind {kind} says it is page {texts[PAGE]}")
    out = []
    for values in records.values():
        if NUMBER not in values or DAY not in values:
            continue
        digits = re.sub(r"\D", "", values[DAY])
        try:
            day = datetime.datetime.strptime(digits, "%Y%m%d").date()
        except ValueError as e:
            raise FeedError(f"a record of page {page} of kind {kind} has no day: {values[DAY]!r}") from e
        if not values[NUMBER]:
            raise FeedError(f"a record of page {page} of kind {kind} has no number")
        if values.get(NAME) != NAMES[kind]:
            raise FeedError(f"a record of page {page} of kind {kind} is of another kind: {values.get(NAME)}")
        out.append((values[NUMBER], values[NAME], day))
    return total, out


class _Page(InputPartition):
    def __init__(self, kind: int, page: int, total: int):
        self.kind, self.page, self.total = kind, page, total


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kinds: Sequence[int]):
        self.folder, self.kinds = folder, kinds

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for kind in self.kinds:
            body = fetch(self.folder, kind, 1)
            if body is None:
                raise FeedError(f"kind {kind} has no first page")
            total, _ = parse_page(body, kind, 1)
            out.extend(_Page(kind, page, total) for page in range(1, max(1, -(-total // SIZE)) + 1))
        return out

    def read(self, partition: _Page) -> Iterator[tuple]:
        kind, page = partition.kind, partition.page
        body = fetch(self.folder, kind, page)
        if body is None:
            raise FeedError(f"page {page} of kind {kind} is missing")
        total, records = parse_page(body, kind, page)
        if total != partition.total:
            raise FeedError(f"kind {kind} had {partition.total} records on its first page and has {total} on page {page}")
        wanted = min(SIZE, total - (page - 1) * SIZE)
        if len(records) != wanted:
            raise FeedError(f"page {page} of kind {kind} has {len(records)} records, not {wanted}")
        for at, (number, name, day) in enumerate(records):
            yield kind, page, at, number, name, day


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "kind int, page int, place int, mst string, kind_name string, deleted_on date"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["folder"], [int(k) for k in self.options.get("kinds", "1,2").split(",")])


def read_feed(spark: SparkSession, folder: str, kinds: Sequence[int] = (1, 2)) -> DataFrame:
    """(kind, page, place, mst, kind_name, deleted_on): all records of all pages, as they come."""
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").option("folder", folder).option("kinds", ",".join(map(str, kinds))).load()


def deletions(feed: DataFrame) -> DataFrame:
    """One row of each (kind, mst, deleted_on); of repeated records the last of the last page."""
    w = Window.partitionBy("kind", "mst", "deleted_on").orderBy(F.desc("page"), F.desc("place"))
    return feed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
