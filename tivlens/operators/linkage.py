"""Linking accumulated value to average annual loss (AAL) per grid point."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tivlens.functions.columns import money_sum, share
from tivlens.operators import expect
from tivlens.operators.sizing import lookup_join
from tivlens.sources.points import with_point_keys

POINT = ["grid_lon", "grid_lat"]


def check_grids(grid: DataFrame, aal: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The exposure grid and the AAL grid have the same points and the same values."""
    grid, aal = with_point_keys(grid), with_point_keys(aal)
    return expect.same_keys(grid, aal, POINT).unionByName(
        expect.close_values(grid, aal, POINT, "value", "project1_tiv", tolerance))


def scenario_stack(points: DataFrame) -> DataFrame:
    """Scenario cells with keys rounded for the join."""
    return with_point_keys(points.select("scenario", *POINT, "total_tiv"))


def link(points: DataFrame, aal: DataFrame) -> DataFrame:
    """AAL scaled by the value of each cell; 0 where the reference value is not positive."""
    reference = with_point_keys(aal).select(*POINT, "project1_tiv", "project1_aal")
    scaled = F.col("project1_aal") * F.col("total_tiv") / F.col("project1_tiv")
    return lookup_join(scenario_stack(points), reference, POINT, "left").withColumn(
        "linked_aal",
        F.when(F.col("project1_aal").isNull(), None)
        .when(F.col("project1_tiv") > 0, scaled).otherwise(0.0),
    ).select("scenario", *POINT, "total_tiv", "project1_tiv", "project1_aal", "linked_aal")


def check_link(points: DataFrame, aal: DataFrame) -> DataFrame:
    """No scenario/cell twice, no reference point twice, no cell without a reference point."""
    stack, reference = scenario_stack(points), with_point_keys(aal)
    return (
        expect.unique(stack, ["scenario", *POINT])
        .unionByName(expect.unique(reference, POINT))
        .unionByName(expect.all_found(stack, reference, POINT))
    )


def scenario_summary(linked: DataFrame, aal: DataFrame) -> DataFrame:
    """AAL per scenario and its relation to the AAL of the reference grid."""
    total = aal.agg(money_sum("project1_aal").alias("t")).scalar()
    grouped = linked.groupBy("scenario").agg(
        F.count("*").alias("grid_cells"),
        money_sum("total_tiv").alias("portfolio_tiv"),
        money_sum("linked_aal").alias("linked_aal"),
    )
    multiple = share(F.col("linked_aal"), total)
    return grouped.select(
        "scenario", "grid_cells", "portfolio_tiv", "linked_aal",
        share(F.col("linked_aal"), F.col("portfolio_tiv")).alias("aal_to_tiv"),
        multiple.alias("aal_multiple_vs_project1"),
        ((multiple - 1.0) * 100).alias("aal_change_vs_project1_pct"),
    ).orderBy("scenario")
