"""Grid points: plain longitude and latitude columns with keys rounded to 8 decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tivlens.functions.columns import key8
from tivlens.model import AAL_POINTS, POINTS
from tivlens.sources.tables import read_csv


def with_point_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"grid_lon": key8("grid_lon"), "grid_lat": key8("grid_lat")})


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Exposure grid ``(grid_lon, grid_lat, value)`` from CSV."""
    return with_point_keys(read_csv(spark, path, POINTS))


def read_aal_grid(spark: SparkSession, path: str) -> DataFrame:
    """AAL grid from CSV, with ``value`` and ``aal`` renamed to the linkage columns."""
    return with_point_keys(read_csv(spark, path, AAL_POINTS)).withColumnsRenamed(
        {"value": "project1_tiv", "aal": "project1_aal"})
