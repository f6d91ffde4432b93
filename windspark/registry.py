"""All queries of the library with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import file_queries as _files  # noqa: F401 - adds its queries
from .plans import queries as _q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict:
    return dict(_q.SQL)
