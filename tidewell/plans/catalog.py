"""Names, queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import complete, features, files, fitting, modeling, ranking, records

_PARTS = (features, ranking, fitting, records, modeling, complete, files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.center_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
