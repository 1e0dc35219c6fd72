"""The stored tables behind the registered queries, each built once per session and data folder.

Mirrors how the library is used: the portfolio, the findings, the scores and the
cleansed portfolio are tables, and every step reads the tables before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tivlens.model import catalogue
from tivlens.operators import (
    accumulate, calibrate, corrupt, detect, evaluate, materiality, spatial, treat)
from tivlens.sources import derived
from tivlens.sources.tables import materialise

AS_OF_YEAR = 2026


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def marked(self) -> DataFrame:
        return materialise(derived.marked_portfolio(self.spark, self.sf_dir), "portfolio", "row_id")

    @property
    def portfolio(self) -> DataFrame:
        return self.marked.drop("m")

    @property
    def clean(self) -> DataFrame:
        return self.marked.filter("m BETWEEN 910 AND 999").drop("m")

    @cached_property
    def catalogue(self) -> DataFrame:
        return catalogue(self.spark)

    @cached_property
    def truth(self) -> DataFrame:
        return evaluate.map_rules(derived.ground_truth_of(self.marked))

    @cached_property
    def validated(self) -> DataFrame:
        return materialise(
            calibrate.materiality_reference(derived.validated_tiv(self.spark, self.sf_dir)), "validated", "row_id")

    @cached_property
    def land(self) -> spatial.PolygonIndex:
        return spatial.polygon_index(derived.land_edges(self.spark))

    @cached_property
    def country(self) -> spatial.PolygonIndex:
        return spatial.polygon_index(derived.country_edges(self.spark))

    @cached_property
    def density(self) -> detect.Threshold:
        return calibrate.read_threshold(calibrate.calibrate_density(self.clean))

    @cached_property
    def building_tiv(self) -> detect.Threshold:
        return calibrate.read_threshold(calibrate.calibrate_building_tiv(self.clean))

    def references(self, only: set[str] | None = None) -> detect.References:
        """References for the given rules; the others are not built."""

        def need(*ids: str) -> bool:
            return only is None or bool(only.intersection(ids))

        land = need(*detect.LAND_RULES)
        return detect.References(
            density=self.density if need("X-005") else None,
            building_tiv=self.building_tiv if need("P-001") else None,
            postcodes=derived.postcodes(self.spark) if need("X-006") else None,
            district_cities=derived.DISTRICT_CITIES,
            land=self.land if land else None,
            country=self.country if land else None,
            as_of_year=AS_OF_YEAR,
        )

    def rule(self, *rule_ids: str) -> DataFrame:
        """Findings of some rules, computed from the portfolio."""
        only = set(rule_ids)
        return detect.detect(self.portfolio, self.references(only), only)

    @cached_property
    def flags(self) -> DataFrame:
        return materialise(detect.detect(self.portfolio, self.references()), "flags", "row_id")

    @cached_property
    def rule_counts(self) -> DataFrame:
        return evaluate.by_rule(self.truth, self.flags, self.catalogue)

    @cached_property
    def materiality_tiv(self) -> DataFrame:
        return materialise(
            materiality.materiality_tiv(self.portfolio, self.validated), "materiality_tiv", "row_id")

    @cached_property
    def percentile(self) -> DataFrame:
        return materialise(materiality.percentiles(self.materiality_tiv), "percentile", "row_id")

    @cached_property
    def findings(self) -> DataFrame:
        return materialise(materiality.enriched_findings(
            self.flags, self.portfolio, self.validated, self.catalogue, self.percentile), "findings", "row_id")

    def cells(self) -> DataFrame:
        return materiality.portfolio_cells(self.portfolio)

    @cached_property
    def concentration(self) -> DataFrame:
        return materialise(
            materiality.concentration(self.findings, self.cells()), "concentration")

    @cached_property
    def scores(self) -> DataFrame:
        return materialise(materiality.scores(self.findings, self.concentration), "scores", "row_id")

    def actions(self) -> DataFrame:
        return treat.with_action(
            treat.findings_with_priority(self.flags, self.scores), self.catalogue)

    @cached_property
    def cleansed(self) -> DataFrame:
        return materialise(
            treat.treat(self.portfolio, self.flags, self.catalogue, self.scores), "cleansed", "row_id")

    @cached_property
    def aal(self) -> DataFrame:
        return derived.grid(self.spark)

    @cached_property
    def grid(self) -> spatial.GridIndex:
        return spatial.grid_index(self.aal)

    @cached_property
    def dirty_points(self) -> DataFrame:
        return materialise(accumulate.dirty(self.portfolio, self.grid), "dirty_points")

    @cached_property
    def usable(self) -> DataFrame:
        # what placing and the comparisons by attribute read, not the whole wide record a second time
        return materialise(accumulate.usable(self.cleansed, self.flags).select(
            "row_id", "district", "occupancy_code", "construction_clean", "latitude_clean", "longitude_clean",
            "tiv_total_clean", "has_p001", "has_p003"), "usable")

    @cached_property
    def placed(self) -> DataFrame:
        return materialise(accumulate.place(self.usable, self.grid), "placed")

    @cached_property
    def clean_points(self) -> DataFrame:
        return materialise(accumulate.cleansed_points(self.placed), "clean_points")

    @cached_property
    def fallback_points(self) -> DataFrame:
        return materialise(accumulate.with_fallback(
            self.placed, self.usable, self.grid, derived.fallback_points(self.spark)), "fallback")

    @cached_property
    def sensitivity(self) -> DataFrame:
        return materialise(accumulate.sensitivity(self.placed), "sensitivity")

    def scenario_points(self) -> DataFrame:
        return accumulate.scenario_points(self.dirty_points, self.sensitivity)

    @cached_property
    def pristine(self) -> DataFrame:
        return materialise(derived.pristine_portfolio(self.spark, self.sf_dir), "pristine")

    @cached_property
    def selected(self) -> DataFrame:
        return corrupt.select_errors(self.pristine)

    @cached_property
    def places(self) -> corrupt.Places:
        districts = [d for d, _, _ in derived.LAND]
        return corrupt.Places(
            {d: [str(700000 + i * 1000 + j) for j in range(10)] for i, d in enumerate(districts)},
            {d: f"{d}ton" for d in districts})

    @cached_property
    def corrupted(self) -> DataFrame:
        return materialise(corrupt.apply_errors(self.selected, self.places), "corrupted")

    @cached_property
    def copies(self) -> DataFrame:
        return materialise(corrupt.duplicate_rows(self.corrupted), "copies")

    @cached_property
    def events(self) -> DataFrame:
        return materialise(corrupt.ground_truth(self.pristine, self.corrupted, self.copies), "events")


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _tune(spark)
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


def _tune(spark: SparkSession) -> None:
    """In local mode, replace the default of 200 shuffle partitions; a cluster's setting stands."""
    if spark.sparkContext.master.startswith("local") and \
            spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set(
            "spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))


def close_all() -> None:
    """Forget the stored tables, so that the next query builds them again."""
    _OPEN.clear()
