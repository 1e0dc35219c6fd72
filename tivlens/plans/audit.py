"""The audit run: calibrate, detect, score, treat, accumulate, link.

Each step writes its table and the next reads it, so a lost executor costs one
step at most and no plan repeats the work of an earlier one. Scores come before
treatment because the audit trail carries the priority of each finding.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tivlens.model import DISTRICT_CITIES, catalogue
from tivlens.operators import (
    accumulate, calibrate, detect, evaluate, expect, linkage, materiality, spatial, treat)
from tivlens.sources.tables import read_table, store_bucketed, write_table


@dataclass(frozen=True)
class Inputs:
    """Tables of one run. ``truth`` is needed only to score the detection."""

    portfolio: DataFrame
    clean: DataFrame
    postcodes: DataFrame
    land: DataFrame
    country: DataFrame
    grid: DataFrame
    fallback: DataFrame
    aal: DataFrame
    truth: DataFrame | None = None
    district_cities: dict[str, str] = field(default_factory=lambda: dict(DISTRICT_CITIES))
    as_of_year: int | None = None


def run_audit(inputs: Inputs, out: str) -> dict[str, DataFrame]:
    """Run everything and return the stored tables by name; ``out`` is a shared folder."""
    spark = inputs.portfolio.sparkSession
    done: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out}/{name}")
        done[name] = read_table(spark, f"{out}/{name}", df.schema)
        return done[name]

    def store_rows(name: str, df: DataFrame) -> DataFrame:
        """A table of records, in buckets of row_id: the joins between such tables need no exchange."""
        done[name] = store_bucketed(df, f"{out}/{name}")
        return done[name]

    def stored_index(name: str, edges: DataFrame) -> spatial.PolygonIndex:
        index = spatial.polygon_index(edges)
        return spatial.PolygonIndex(store(name, index.cells), index.size, index.small)

    # checks that need no grouping ride along with the first writing of their table
    watched = expect.Watch().no_nulls("tiv_total").positive("tiv_total")
    portfolio, rules = store_rows("portfolio", inputs.portfolio), catalogue(spark)
    reference = store_rows("materiality_tiv_reference", calibrate.materiality_reference(watched.on(inputs.clean)))
    watched.enforce()
    expect.enforce(expect.unique(portfolio, ["row_id"]))
    store("rule_catalogue", rules)
    density = store("x005_reference", calibrate.calibrate_density(inputs.clean))
    building = store("p001_reference", calibrate.calibrate_building_tiv(inputs.clean))

    flags = store_rows("quality_flags", detect.detect(portfolio, detect.References(
        density=calibrate.read_threshold(density),
        building_tiv=calibrate.read_threshold(building),
        postcodes=inputs.postcodes,
        district_cities=inputs.district_cities,
        land=stored_index("land_index", inputs.land),
        country=stored_index("country_index", inputs.country),
        as_of_year=inputs.as_of_year,
    )))

    if inputs.truth is not None:
        truth = evaluate.require_mapped(inputs.truth)
        per_rule = store("detection_performance", evaluate.by_rule(truth, flags, rules))
        store("detection_performance_by_dimension", evaluate.by_dimension(per_rule, truth))
        store("completeness_coverage", evaluate.completeness_coverage(per_rule))
        store("detection_overall", evaluate.overall(per_rule))

    tiv = store_rows("materiality_tiv", materiality.materiality_tiv(portfolio, reference))
    percentile = store_rows("tiv_percentile", materiality.percentiles(tiv))
    findings = store_rows("findings", materiality.enriched_findings(
        flags, portfolio, reference, rules, percentile))
    concentrated = store("concentration", materiality.concentration(
        findings, materiality.portfolio_cells(portfolio)))
    scores = store_rows("materiality_scores", materiality.scores(findings, concentrated))
    store("materiality_funnel", materiality.funnel(portfolio, scores, reference))

    cleansed = store_rows("portfolio_cleansed", treat.treat(portfolio, flags, rules, scores))
    store("treatment_summary", treat.summary(cleansed))

    grid = spatial.grid_index(inputs.grid)
    store("accumulation_critical_referred", accumulate.critical_referred(cleansed, flags))
    dirty = store("accumulation_dirty", accumulate.dirty(portfolio, grid))
    usable = store("usable_records", accumulate.usable(cleansed, flags))
    placed = store("placed_records", accumulate.place(usable, grid))
    clean_points = store("accumulation_cleansed", accumulate.cleansed_points(placed))
    fallback = store("accumulation_cleansed_fallback", accumulate.with_fallback(
        placed, usable, grid, inputs.fallback))
    store("accumulation_fallback_comparison",
          accumulate.fallback_comparison(clean_points, fallback))
    both = accumulate.both_statuses(dirty, clean_points)
    store("accumulation_summary", accumulate.totals(both))
    store("accumulation_top10", accumulate.top_points(both))
    store("accumulation_concentration", accumulate.concentration(clean_points))
    sensitivity = store("accumulation_sensitivity", accumulate.sensitivity(placed))
    expect.enforce(expect.present(sensitivity, "scenario", accumulate.SCENARIOS[1:]))
    store("accumulation_sensitivity_summary", accumulate.sensitivity_summary(sensitivity))
    compared = store("accumulation_comparison", accumulate.comparison(dirty, clean_points))
    store("accumulation_largest_changes", accumulate.largest_changes(compared))
    for name, raw, clean in (
        ("district", "district", "district"),
        ("occupancy", "occupancy_code", "occupancy_code"),
        ("construction", "construction_code", "construction_clean"),
    ):
        store(f"accumulation_{name}", accumulate.by_attribute(portfolio, usable, raw, clean))

    points = accumulate.scenario_points(dirty, sensitivity)
    store("accumulation_impact_summary", accumulate.impact_summary(points))
    expect.enforce(
        linkage.check_grids(inputs.grid, inputs.aal), linkage.check_link(points, inputs.aal))
    linked = store("aal_scenario_cell_linkage", linkage.link(points, inputs.aal))
    store("aal_scenario_summary", linkage.scenario_summary(linked, inputs.aal))
    return done
