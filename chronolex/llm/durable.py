"""Tables kept in the folder that the cluster shares, so that a lost executor costs no lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new local one only where it is unset and all runs on one machine."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{_SETTING} has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep_in(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, over what is there, and return it as read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it as read back.

    Whoever runs the job clears the folder after it; the result may still read these tables.
    """
    return keep_in(df, new_path(df.sparkSession, name))


def hash_of(docs: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """A hash of all ``columns``; maps, which have no hash, go by their JSON text."""
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *plain)


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on: functions over Arrow batches can't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't use, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name
