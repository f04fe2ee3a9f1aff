"""Every registered query of the library proper, with its SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolex.plans import base

for _name in ("scans", "joins", "aggregates", "retrieval", "evaluation", "synchronisation", "workflows", "bodies", "grounding", "publication", "states", "feeds", "gold", "audits", "answers"):
    importlib.import_module(f"chronolex.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["flagship_temporal_search"](spark, sf_dir)
