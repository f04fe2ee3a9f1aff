"""Hand-off bundles: sorted JSON lines with a manifest of checksums, written last and verified on load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(tables: dict[str, DataFrame], keys: dict[str, str], path: str) -> DataFrame:
    """Write each table range-partitioned and sorted by its key, then the manifest; returns the manifest rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.repartitionByRange(F.col(keys[name])).sortWithinPartitions(keys[name]).write.mode("errorifexists").json(f"{path}/{name}")
    manifest = _checksums(spark, path, list(tables))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema("name string, file string, bytes long, sha256 string").json(f"{path}/manifest")


def _checksums(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{name}")
        one = files.select(F.lit(name).alias("name"), F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def verify_bundle(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files that the manifest and the folder don't agree on; empty if the bundle is whole."""
    said = spark.read.schema("name string, file string, bytes long, sha256 string").json(f"{path}/manifest").withColumnRenamed("sha256", "said")
    found = _checksums(spark, path, names)
    both = said.select("name", "file", "said").join(found.select("name", "file", "sha256"), ["name", "file"], "full")
    return both.where(~F.col("said").eqNullSafe(F.col("sha256")))


def load_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle whose checksums hold."""
    bad = verify_bundle(spark, path, list(schemas)).limit(5).collect()
    if bad:
        raise ValueError(f"bundle files differ from the manifest: {json.dumps([[r['name'], r['file']] for r in bad])}")
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}
