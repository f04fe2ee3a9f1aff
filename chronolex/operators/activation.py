"""Rules that a document version has to meet before it becomes active, and the state it then gets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions import hashing as H
from chronolex.sources import trees

# Fixed values of the source format: keys that mark a record, values that mean yes, article paths and structure signs.
DELETED_KEY = "삭제여부"
ABOLISHED_FLAG, ABOLISHED_DATES = "폐지여부", ("폐지일자", "폐지일")
SUPPLEMENTARY_KEYS = ("부칙", "부칙단위", "부칙내용")
YES = ("1", "true", "y", "yes", "예", "폐지", "삭제")
ARTICLE = r"^제[0-9]+조(의[0-9]+)?$"
STRUCTURE = r"^\s*제\s*[0-9]+\s*(?:장|절)(?:의\s*[0-9]+)?(?:\s|$)"

#: The rules in their order; the first that a version breaks is its problem.
RULES = (
    "no_title", "no_source_id", "no_mst", "no_effective_from", "parser_version", "no_provisions", "duplicate_path", "empty_content", "parent_absent", "not_an_article", "no_parent_path", "structure_marker",
    "parent_elsewhere", "article_root_absent", "provision_id", "raw_format", "raw_sha256", "unreadable",
)


def canonical_id(namespace: uuid.UUID, effective_from: Column, mst: Column, path: Column, source_id: Column, source_kind: Column) -> Column:
    """The id that a provision has to carry: a name-based UUID of what identifies it."""
    return H.uuid5(namespace, H.canonical_json(effective_from=effective_from.cast("string"), mst=mst, path=path, source_id=source_id, source_kind=source_kind))


def provision_faults(versions: DataFrame, provisions: DataFrame, namespace: uuid.UUID) -> DataFrame:
    """version_id and, for each rule on provisions, whether it is broken; versions without provisions aren't in it.

    ``provisions`` has version_id, path, parent_path, content and provision_id. All steps group or join by version first,
    so no version's tree is collected into one value. A null path is no article.
    """
    facts = versions.select("version_id", "source_kind", "source_id", "mst", "effective_from")
    paths = provisions.groupBy("version_id", "path").agg(F.count("*").alias("copies"))
    known = paths.select("version_id", F.col("path").alias("parent_path"), F.lit(True).alias("parent_known"))
    rows = provisions.join(known, ["version_id", "parent_path"], "left").join(facts, "version_id")
    root, parent_root = F.substring_index("path", "/", 1), F.substring_index("parent_path", "/", 1)
    is_law, is_article = F.col("source_kind") == "law", F.coalesce(root.rlike(ARTICLE), F.lit(False))
    top, blank = F.col("parent_path").isNull(), F.length(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))) == 0
    is_root = top & (F.col("path") == root)
    expected = canonical_id(namespace, F.col("effective_from"), F.col("mst"), F.col("path"), F.col("source_id"), F.col("source_kind"))
    flags = {
        "empty_content": blank, "parent_absent": ~top & F.col("parent_known").isNull(), "not_an_article": is_law & ~is_article, "no_parent_path": is_law & is_article & top & ~is_root,
        "structure_marker": is_law & is_root & F.coalesce(F.col("content").rlike(STRUCTURE), F.lit(False)), "parent_elsewhere": is_law & ~top & (parent_root != root),
        "provision_id": ~F.col("provision_id").eqNullSafe(expected),
    }
    by_article = rows.groupBy("version_id", root.alias("article")).agg(
        *[F.bool_or(f).alias(name) for name, f in flags.items()], F.bool_or(is_law & is_article).alias("counted"), F.bool_or(is_root).alias("has_root")
    )
    found = by_article.groupBy("version_id").agg(*[F.bool_or(name).alias(name) for name in flags], F.bool_or(F.col("counted") & ~F.coalesce("has_root", F.lit(False))).alias("article_root_absent"))
    copies = paths.groupBy("version_id").agg(F.bool_or(F.col("copies") > 1).alias("duplicate_path"))
    return found.join(copies, "version_id")


def activation(versions: DataFrame, provisions: DataFrame, today: Column, parser: str, namespace: uuid.UUID) -> DataFrame:
    """version_id, problem (the first broken rule, null if none) and what an active version gets.

    ``versions`` has version_id, title, source_id, mst, effective_from, parser_version, source_kind, raw_format,
    wire_format, raw_sha256 and body. lifecycle_state, record_state and has_supplementary are null beside a problem.
    A null in a compared column breaks its rule. Marks are read off the parsed body, at any depth; a body that can't be
    read in its wire format is refused.
    """
    tree = trees.nodes(versions, "version_id", "body", "wire_format", whole="삭제여부|폐지")
    mark = trees.marks(tree, "version_id", YES, DELETED_KEY, ABOLISHED_FLAG, ABOLISHED_DATES, SUPPLEMENTARY_KEYS)
    rows = versions.join(provision_faults(versions, provisions, namespace).withColumn("_held", F.lit(True)), "version_id", "left").join(mark, "version_id", "left")
    empty = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    broken = {
        "no_title": empty("title"), "no_source_id": empty("source_id"), "no_mst": empty("mst"), "no_effective_from": F.col("effective_from").isNull(),
        "parser_version": ~F.col("parser_version").eqNullSafe(F.lit(parser)), "no_provisions": F.col("_held").isNull(),
        "raw_format": ~F.upper("raw_format").eqNullSafe(F.col("wire_format")), "raw_sha256": ~F.col("raw_sha256").eqNullSafe(F.sha2("body", 256)),
    }
    problem = F.coalesce(*[F.when(broken[name] if name in broken else F.col(name), F.lit(name)) for name in RULES])
    state = F.when(F.col("abolished"), "abolished").when(F.col("effective_from") > today, "scheduled").otherwise("active")
    judged = rows.select(
        "version_id", problem.alias("problem"), state.alias("lifecycle_state"), F.when(F.col("deleted"), "deleted").otherwise("available").alias("record_state"), F.col("supplementary").alias("has_supplementary")
    )
    fine = F.col("problem").isNull()
    return judged.select("version_id", "problem", *[F.when(fine, F.col(c)).alias(c) for c in ("lifecycle_state", "record_state", "has_supplementary")])
