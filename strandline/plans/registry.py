"""The registered queries outside the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, cells, controls, dense, etl, extra, more, paths, recursions, streams  # noqa: F401  importing a plan module registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, scores, graph-resolvent weights and the amplification of every month."""
    return base.QUERIES["tau_soft_resolvent"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
