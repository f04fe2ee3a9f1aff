"""Readers of structured document bodies: JSON and XML trees to path-addressed rows, feeds, caches and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.text import collapse_whitespace, compact_date

_ITEM = "array<struct<no:string,text:string,subitems:array<struct<no:string,text:string>>>>"
_PARAGRAPH = f"array<struct<no:string,text:string,items:{_ITEM}>>"
_NODES = "array<struct<path:string,parent_path:string,heading:string,content:string>>"
#: The shape of a body; unknown fields are ignored, missing ones are null.
BODY = f"struct<source_id:string,mst:string,title:string,effective_from:string,articles:array<struct<number:string,branch:string,kind:string,title:string,text:string,paragraphs:{_PARAGRAPH}>>>"


def parse_body(body: Column, path_xml: str = "document") -> Column:
    """struct<document, reason>: the body as JSON or, where it isn't JSON, as XML with the reason; both null if neither."""
    is_json = F.try_parse_json(body).isNotNull()
    is_xml = F.coalesce(F.ltrim(body).startswith("<"), F.lit(False))
    xml = F.when(is_xml, F.from_xml(body, BODY, {"rowTag": path_xml}))
    return F.struct(
        F.when(is_json, F.from_json(body, BODY)).otherwise(xml).alias("document"), F.when(~is_json & is_xml, "not JSON, read as XML").when(~is_json, "neither JSON nor XML").alias("reason")
    )


def missing_identity(document: Column) -> Column:
    """Names of the identity fields that a body lacks; such a body must be refused."""
    fields = F.array(*[F.when(F.coalesce(F.trim(document[c]), F.lit("")) == "", F.lit(c)) for c in ("source_id", "mst", "title", "effective_from")])
    bad_date = F.when(compact_date(document["effective_from"]).isNull(), F.lit("effective_from"))
    return F.array_distinct(F.filter(F.concat(fields, F.array(bad_date)), lambda x: x.isNotNull()))


def flatten_tree(documents: DataFrame, key: str = "id") -> DataFrame:
    """key, path, parent_path, heading, content and ordinal of every node of ``document`` (BODY), in document order.

    Paths are ``a7``, ``a7b2`` for a branch article, then ``/p<no>/i<no>/s<no>``. Entries of another kind than
    ``article`` (where a kind is given) are skipped, nodes without text are left out, their children keep their paths,
    and an article header that comes twice is emitted once.
    """
    none = F.lit(None).cast("string")

    def node(path: Column, parent: Column, heading: Column, content: Column) -> Column:
        return F.struct(path.alias("path"), parent.alias("parent_path"), heading.alias("heading"), collapse_whitespace(content).alias("content"))

    def below(nodes: Column, made) -> Column:
        return F.coalesce(F.flatten(F.transform(nodes, made)), F.array().cast(_NODES))

    def of_item(parent: Column):
        def made(i: Column) -> Column:
            path = F.concat(parent, F.lit("/i"), i["no"])
            return F.concat(F.array(node(path, parent, none, i["text"])), below(i["subitems"], lambda s: F.array(node(F.concat(path, F.lit("/s"), s["no"]), path, none, s["text"]))))

        return made

    def of_paragraph(parent: Column):
        def made(p: Column) -> Column:
            path = F.concat(parent, F.lit("/p"), p["no"])
            return F.concat(F.array(node(path, parent, none, p["text"])), below(p["items"], of_item(path)))

        return made

    def of_article(a: Column) -> Column:
        path = F.concat(F.lit("a"), a["number"], F.coalesce(F.concat(F.lit("b"), F.nullif(a["branch"], F.lit(""))), F.lit("")))
        nodes = F.concat(F.array(node(path, none, a["title"], a["text"])), below(a["paragraphs"], of_paragraph(path)))
        return F.when(F.coalesce(a["kind"] == "article", F.lit(True)), nodes).otherwise(F.array().cast(_NODES))

    # one pass over the parsed tree in document order, and one shuffle for both windows
    rows = documents.select(key, F.posexplode(below(F.col("document.articles"), of_article)).alias("_at", "n")).select(key, "_at", "n.*")
    rows = rows.where("coalesce(content, '') <> '' or heading is not null").repartition(key)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "path").orderBy("_at"))).where("_n = 1")
    return first.select(key, "path", "parent_path", "heading", "content", F.row_number().over(Window.partitionBy(key).orderBy("_at")).alias("ordinal"))


def regroup_flat(items: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Flat sub-items with ``group_no``: a new group begins wherever the first label comes again."""
    w = Window.partitionBy(*by).orderBy(order)
    first = items.withColumn("_first", F.first(label).over(w))
    return first.withColumn("group_no", F.sum((F.col(label) == F.col("_first")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def zip_to_parents(groups: DataFrame, parents: DataFrame, by: list[str], parent_order: str) -> DataFrame:
    """Groups joined in order with the parents that may hold them."""
    ranked = parents.withColumn("group_no", F.row_number().over(Window.partitionBy(*by).orderBy(parent_order)))
    return groups.join(ranked, [*by, "group_no"])


def numbered_sections(text: Column) -> Column:
    """array<string>: the text cut before each section number such as ``3.2``; fewer than two numbers leave it whole.

    Numbers inside dates, decimals and ranges don't count: what stands before must not be a digit, point or dash, and
    what comes after must be white space. Text before the first number stays with the first section.
    """
    mark = r"(?<![\d.~-])\b\d{1,2}\.\d{1,2}(?=\s)"
    parts = F.split(text, f"(?={mark})", -1)
    n = F.regexp_count(text, F.lit(mark))
    glued = F.when(
        F.get(parts, F.lit(0)).rlike(f"^(?:{mark})") | (F.size(parts) < 2), parts
    ).otherwise(F.concat(F.array(F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))))
    return F.when(n < 2, F.array(text)).otherwise(F.transform(glued, lambda x: F.rtrim(x)))


def rule_paragraphs(rows: DataFrame, key: str, order: str, text: str, root: str = "body") -> DataFrame:
    """Flat paragraphs with a path from the article number that they open with, else ``body/p<i>``; repeats get a suffix."""
    number = F.regexp_extract(text, r"^\s*(?:Article|Art\.)\s*(\d+)", 1)
    path = F.when(number != "", F.concat(F.lit("a"), number)).otherwise(F.concat(F.lit(f"{root}/p"), F.row_number().over(Window.partitionBy(key).orderBy(order))))
    named = rows.withColumn("path", path)
    again = F.row_number().over(Window.partitionBy(key, "path").orderBy(order))
    return named.withColumn("_n", again).withColumn("path", F.when(F.col("_n") > 1, F.concat("path", F.lit("~"), "_n")).otherwise(F.col("path"))).drop("_n")


def text_blocks(lines: DataFrame, key: str, order: str, line: str, header: str = r"^Article \d+") -> DataFrame:
    """Blocks of lines: each header line opens one, what stands before the first header is block 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.col(line).rlike(header).cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return numbered.groupBy(key, "block").agg(F.array_join(F.transform(body, lambda x: x["l"]), "\n").alias("text"), F.count("*").alias("n_lines"))


def assign_chapters(rows: DataFrame, key: str, order: str, chapter: Column) -> DataFrame:
    """Rows with the latest chapter marker at or before them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.last(chapter, ignorenulls=True).over(w))


def missing_in_range(rows: DataFrame, number: str, low: int, high: int) -> DataFrame:
    """Numbers from low to high that no row has."""
    wanted = rows.sparkSession.range(low, high + 1).withColumnRenamed("id", number)
    return wanted.join(rows.select(F.col(number).cast("long")).distinct(), number, "left_anti")


def search_listing(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """Entries of a JSON search listing with parsed dates; the listing's place is kept."""
    entries = F.from_json(body, "struct<results:array<struct<title:string,source_id:string,mst:string,effective_from:string,link:string>>>")["results"]
    rows = bodies.select(key, F.posexplode(entries).alias("place", "e"))
    return rows.select(key, "place", collapse_whitespace(F.col("e.title")).alias("title"), "e.source_id", "e.mst", compact_date(F.col("e.effective_from")).alias("effective_from"), "e.link")


def version_history(entries: DataFrame, order: str) -> DataFrame:
    """Of several entries of one (mst, effective_from) the last."""
    w = Window.partitionBy("mst", "effective_from").orderBy(F.desc(order))
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deletion_feed(pages: DataFrame, kind: str) -> DataFrame:
    """Distinct (mst, deleted_on) of one kind over all pages of the feed."""
    return pages.where(F.col("kind") == kind).select("mst", compact_date(F.col("deleted_on")).alias("deleted_on")).where("deleted_on is not null").dropDuplicates(["mst", "deleted_on"])


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a blank or malformed line fails the read."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    blank = F.trim("value") == ""
    return lines.select(F.when(blank, F.raise_error(F.lit("blank line in JSON lines"))).otherwise(parsed).alias("r")).select("r.*")


def read_vector_cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """An append-only cache of JSON lines: the last record of a key wins and a torn last line is let go.

    A cache file is read as one value, for the order of its lines; large caches are folders of many files, whose names
    give the order between them.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    lines = files.select("_file", F.size(F.split("value", "\n")).alias("_n"), F.posexplode(F.split("value", "\n")).alias("_line", "_text")).where("trim(_text) <> ''")
    rows = lines.withColumn("_ok", F.try_parse_json("_text").isNotNull()).withColumn("r", F.from_json("_text", schema))
    torn = ~F.col("_ok") & (F.col("_line") == F.col("_n") - 1)
    checked = rows.where(~torn).withColumn("r", F.when(~F.col("_ok"), F.raise_error(F.lit("malformed line in a vector cache"))).otherwise(F.col("r")))
    flat = checked.select("_file", "_line", "r.*")
    w = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_line"))
    return flat.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file", "_line")


# A section number of a technical standard, not part of a date, a range or a sentence that only names it.
SECTION = r"(?<!\d)(?<!\d\.)(\d+\.\d+)(?![\d.])(?!에도|에서|으로|부터|까지|을|를|에|의|과|와|로)(?!\s+및(?:\s|$))\s*(?=[가-힣<])"


def standard_sections(text: Column) -> Column:
    """array<struct<number, text>>: ``text`` cut before each section number; none if there are fewer than two.

    What stands before the first number is put in front of the first section.
    """
    parts = F.split(text, f"(?={SECTION})", -1)
    numbers = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    trimmed = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    opens = F.size(parts) == F.size(numbers)  # the text begins with a number
    body = F.when(opens, trimmed).otherwise(F.slice(trimmed, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    prefix = F.when(opens, F.lit("")).otherwise(F.get(trimmed, F.lit(0)))
    glued = F.transform(body, lambda s, k: F.when((k == 0) & (prefix != ""), F.concat(prefix, F.lit(" "), s)).otherwise(s))
    made = F.transform(F.arrays_zip(numbers.alias("number"), glued.alias("text")), lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text")))
    return F.when(F.size(numbers) >= 2, made).otherwise(F.array().cast("array<struct<number:string,text:string>>"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of ``schema``, blank ones left out; a line that isn't JSON of it fails the read."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def corpus_index(records: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The record of each (document_id, path), the last by ``order``, and the children of each (document_id, parent_path), by ordinal."""
    w = Window.partitionBy("document_id", "path").orderBy(F.desc(order))
    by_path = records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    child = F.struct("ordinal", F.col(order).alias("_order"), "provision_id")
    children = records.where("parent_path is not null").groupBy("document_id", "parent_path").agg(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["provision_id"]).alias("children"))
    return by_path, children
