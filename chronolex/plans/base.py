"""Registration of queries, and the corpus views that they share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read on demand; Catalyst prunes the columns that a query doesn't use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def versions(self) -> DataFrame:
        """Document versions: orders by customer, each valid from its day until the customer's next day with an order."""
        state = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("abolished")
        rows = self.orders.select(
            F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("effective_from"), state.alias("lifecycle_state"),
            F.when(F.col("o_orderkey") % 37 == 0, "deleted").otherwise("available").alias("record_state"),
            F.when(F.col("o_orderkey") % 41 == 0, "2").otherwise("3").alias("parser_version"), F.col("o_orderpriority").alias("ministry"), F.col("o_totalprice").alias("price"),
        )
        return temporal.effective_periods(rows)

    @property
    def provisions(self) -> DataFrame:
        """Provisions: the lines of documents, addressed by document and place."""
        lines = self.documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "content"))
        return lines.select(
            "doc_id", "source", "lang", "ordinal", (F.col("doc_id") * 100000 + F.col("ordinal")).alias("provision_id"),
            F.concat(F.lit("d"), F.col("doc_id"), F.lit("/p"), F.col("ordinal")).alias("path"), "content",
        )


#: The same views in the oracle's SQL, for a WITH clause.
VERSIONS = """versions AS (
  SELECT o_custkey AS document_id, o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS effective_from,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'scheduled' ELSE 'abolished' END AS lifecycle_state,
    CASE WHEN o_orderkey % 37 = 0 THEN 'deleted' ELSE 'available' END AS record_state,
    CASE WHEN o_orderkey % 41 = 0 THEN '2' ELSE '3' END AS parser_version, o_orderpriority AS ministry, o_totalprice AS price,
    min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)
      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS effective_to
  FROM orders)"""
PROVISIONS = """provisions AS (
  SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS ordinal, doc_id * 100000 + i - 1 AS provision_id,
    'd' || doc_id || '/p' || (i - 1) AS path, lines[i] AS content
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents), unnest(generate_series(1, len(lines))) AS u(i))"""
SEARCHABLE = "record_state = 'available' AND (lifecycle_state IN ('active', 'scheduled') OR (lifecycle_state = 'abolished' AND effective_to IS NOT NULL)) AND parser_version = '3'"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as query ``name``, with the SQL that gives the same rows if there is one."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return put
