"""All registered queries of the raster library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_data, queries_raster


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**queries_raster.QUERIES, **queries_data.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_raster.ORACLE_SQL, **queries_data.ORACLE_SQL}
