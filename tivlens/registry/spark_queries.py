"""One query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tivlens.functions.columns import money_sum
from tivlens.model import PORTFOLIO, RULES
from tivlens.operators import (
    accumulate as acc, calibrate, corrupt, evaluate, expect, linkage, materiality, ordering,
    sampling, spatial, treat)
from tivlens.operators.detect import References, detect
from tivlens.plans.audit import Inputs, run_audit
from tivlens.registry.workspace import AS_OF_YEAR, Workspace, workspace
from tivlens.sources import derived, geojson, points, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[Workspace], DataFrame]], Callable]:
    """Register a function of the workspace under ``name``."""

    def register(build: Callable[[Workspace], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        return build

    return register


def r10(c: str | Column) -> Column:
    """Ratios are compared at ten decimals."""
    return F.round(c, 10)


def cents(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of sums are compared at two decimals."""
    return df.withColumns({c: F.round(c, 2) for c in columns})


# ----------------------------------------------------------------- A sources

@query("a01_csv_scan")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/portfolio-csv-{uuid.uuid4().hex}"
    tables.write_csv(w.portfolio, path)
    back = tables.read_csv(w.spark, path, PORTFOLIO)
    return back.groupBy("district").agg(
        F.count("*").alias("rows"), F.count("postcode").alias("postcodes"),
        F.min("postcode").alias("first_postcode"), money_sum("tiv_total").alias("total"))


@query("a01_malformed_fields")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/malformed-csv-{uuid.uuid4().hex}"
    k, text = F.col("row_id"), {c: F.col(c).cast("string") for c in ("year_built", "num_storeys")}
    tables.write_csv(w.portfolio.withColumns({
        "year_built": F.when(k % 97 == 0, F.lit("19x5")).otherwise(text["year_built"]),
        "num_storeys": F.when(k % 89 == 0, F.lit("12O0")).otherwise(text["num_storeys"])}), path)
    back = tables.materialise(tables.read_csv(w.spark, path, PORTFOLIO, errors="keep"), "scan")
    rules = {"C-003": "year_built", "C-004": "num_storeys"}
    found = detect(back, References(), set(rules)).groupBy("rule_id").agg(F.count("*").alias("missing"))
    wrong = back.select(F.explode("malformed").alias("m")).groupBy("m.field", "m.value").agg(F.count("*").alias("malformed"))
    named = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(f)) for r, f in rules.items()])
    return wrong.join(found.select(named.alias("field"), "missing"), "field")


@query("a01_well_formed")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/short-csv-{uuid.uuid4().hex}"
    columns = ["row_id", "district", "latitude", "tiv_total"]
    k = F.col("row_id")
    # some lines end early, some fields are no numbers
    line = F.concat_ws(",", k, "district", F.when(k % 71 == 0, "20.5N").otherwise(F.coalesce(F.col("latitude").cast("string"), F.lit(""))),
                       F.when(k % 53 != 0, F.col("tiv_total").cast("string")))
    header = w.spark.range(1).select(F.lit(",".join(columns)).alias("value"))
    header.unionByName(w.portfolio.select(line.alias("value"))).coalesce(1).write.text(path)
    return expect.well_formed(tables.read_csv(
        w.spark, path, T.StructType([PORTFOLIO[c] for c in columns]), errors="keep"))


@query("a03_geojson_boundaries")
def _(w: Workspace) -> DataFrame:
    """Boxes around the districts' points with a hole each, one of them in two parts, as clockwise rings."""
    path = f"{tables.shared_dir(w.spark)}/boundaries-{uuid.uuid4().hex}"
    points_of = w.portfolio.filter("latitude BETWEEN 15 AND 25 AND longitude BETWEEN 80 AND 90").select(
        "row_id", "district", "latitude", "longitude")
    box = points_of.groupBy("district").agg(*[
        F.round(f(c), 2).alias(n) for f, c, n in (
            (F.min, "longitude", "xl"), (F.max, "longitude", "xh"), (F.min, "latitude", "yl"), (F.max, "latitude", "yh"))])

    def ring(xl, yl, xh, yh) -> Column:
        return F.array(*[F.array(x, y) for x, y in ((xl, yl), (xl, yh), (xh, yh), (xh, yl), (xl, yl))])

    xl, yl, xh, yh = (F.col(c) for c in ("xl", "yl", "xh", "yh"))
    third = [xl + (xh - xl) / 4, yl + (yh - yl) / 4, xl + (xh - xl) / 2, yl + (yh - yl) / 2]
    main = F.array(ring(xl, yl, xh, yh), ring(*third))
    part = F.array(ring(xl - 2, yl, xl - 1, yh))
    name = F.struct(F.concat(F.lit("District "), "district").alias("NAME"))
    feature = F.when(F.col("district") == "A", F.to_json(F.struct(
        F.lit("Feature").alias("type"), name.alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(main, part).alias("coordinates")).alias("geometry")))
    ).otherwise(F.to_json(F.struct(
        F.lit("Feature").alias("type"), name.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), main.alias("coordinates")).alias("geometry"))))
    # one row per district
    whole = box.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": [\n'), F.array_join(F.sort_array(
        F.collect_list(feature)), ",\n"), F.lit("\n]}")).alias("value"))
    whole.coalesce(1).write.text(path)
    edges = geojson.read_boundaries(w.spark, path, "NAME", {f"District {d}": d for d in "ABC"})
    index = spatial.polygon_index(edges)
    inside = spatial.polygons_at(points_of, index, "longitude", "latitude", "inside")
    return inside.select(F.explode("inside").alias("poly_id")).groupBy("poly_id").agg(F.count("*").alias("points"))


@query("a04_point_grid")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/grid-csv-{uuid.uuid4().hex}"
    # what other programs write: coordinates that differ beyond the eighth decimal
    noise = (F.col("row_id") % 7) * 1e-10
    tables.write_csv(w.portfolio.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        (F.round(F.col("longitude") * 4, 0) / 4 + noise).alias("grid_lon"),
        (F.round(F.col("latitude") * 4, 0) / 4 - noise).alias("grid_lat"), F.col("tiv_building").alias("value")), path)
    return points.read_grid(w.spark, path).groupBy("grid_lon", "grid_lat").agg(
        F.count("*").alias("points"), money_sum("value").alias("value"))


@query("a05_append_and_replace")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/table-{uuid.uuid4().hex}"
    rows, first = w.portfolio.select("row_id", "district"), F.coalesce(F.col("district"), F.lit("")).isin("A", "B")
    tables.write_table(rows, path)
    tables.write_table(rows.filter(first), path)
    tables.write_table(rows.filter(~first), path, mode="append")
    return tables.read_table(w.spark, path).groupBy("district").agg(F.count("*").alias("rows"))


@query("a06_table_read")
def _(w: Workspace) -> DataFrame:
    return tables.read_table(w.spark, f"{w.sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"))


@query("a08_keyed_replace")
def _(w: Workspace) -> DataFrame:
    new = w.clean.select("row_id", "district", (F.col("tiv_total") * 2).alias("tiv_total"))
    return tables.replace_keyed(w.portfolio.select(new.columns), new, "row_id")


@query("a08_replace_in_place")
def _(w: Workspace) -> DataFrame:
    path = f"{tables.shared_dir(w.spark)}/keyed-{uuid.uuid4().hex}"
    new = w.clean.select("row_id", "district", (F.col("tiv_total") * 2).alias("tiv_total"))
    tables.store_keyed(w.portfolio.select(new.columns), path, "row_id", 16)
    tables.replace_in_place(w.spark, path, new, "row_id", 16)
    return tables.read_keyed(w.spark, path)


@query("a09_rule_catalogue")
def _(w: Workspace) -> DataFrame:
    found = w.flags.groupBy("rule_id").agg(F.count("*").alias("flags"))
    return F.broadcast(w.catalogue.select(
        "rule_id", "dimension", "severity", "classification", "injection_rule",
        "tested_by_injection")).join(found, "rule_id", "left").withColumn(
        "flags", F.coalesce("flags", F.lit(0)))


@query("a10_axis_flags")
def _(w: Workspace) -> DataFrame:
    axes = w.catalogue.select(
        "rule_id", "affects_hazard", "affects_vulnerability", "affects_financial")
    return w.flags.join(F.broadcast(axes), "rule_id").groupBy(*axes.columns).agg(
        F.count("*").alias("flags"))


@query("a13_row_numbers")
def _(w: Workspace) -> DataFrame:
    orders = tables.read_table(w.spark, f"{w.sf_dir}/orders.parquet").select("o_orderkey")
    return ordering.row_numbers(orders, "o_orderkey")


@query("a14_code_map")
def _(w: Workspace) -> DataFrame:
    named = tables.map_codes(w.portfolio, "district", {"A": "Alpha", "B": "Beta", "D": "Delta"}, "name")
    return named.groupBy("name").agg(F.count("*").alias("rows"))


# ------------------------------------------------------------ B expectations



@query("b01_row_count")
def _(w: Workspace) -> DataFrame:
    # one row per order and one more for each copied one
    orders = tables.read_table(w.spark, f"{w.sf_dir}/orders.parquet")
    expected = orders.agg(F.count("*") + F.count_if(
        (F.col("o_orderkey") % 1000).between(906, 909))).first()[0]
    return expect.row_count(w.portfolio, expected)


@query("b02_no_nulls")
def _(w: Workspace) -> DataFrame:
    return expect.no_nulls(w.portfolio, "tiv_total").unionByName(
        expect.no_nulls(w.portfolio, "latitude"))


@query("b03_positive")
def _(w: Workspace) -> DataFrame:
    return expect.positive(w.portfolio, "tiv_total").unionByName(
        expect.positive(w.clean, "tiv_total"))


@query("b04_unmapped_codes")
def _(w: Workspace) -> DataFrame:
    return expect.unmapped(w.portfolio, w.clean.select("construction_code"), "construction_code")


@query("b05_unique_key")
def _(w: Workspace) -> DataFrame:
    return expect.unique(w.portfolio, ["row_id"]).unionByName(
        expect.unique(w.portfolio, ["location_id"]))


@query("b06_same_keys")
def _(w: Workspace) -> DataFrame:
    return expect.same_keys(w.dirty_points, w.clean_points, ["grid_lon", "grid_lat"])


@query("b07_close_values")
def _(w: Workspace) -> DataFrame:
    return expect.close_values(
        w.dirty_points, w.clean_points, ["grid_lon", "grid_lat"], "total_tiv", "total_tiv")


@query("b08_reference_found")
def _(w: Workspace) -> DataFrame:
    return expect.all_found(
        w.portfolio.filter("postcode IS NOT NULL"), derived.postcodes(w.spark), ["postcode"]
    ).unionByName(expect.all_found(w.portfolio, w.validated, ["row_id"]))


@query("b09_categories_present")
def _(w: Workspace) -> DataFrame:
    return expect.present(w.sensitivity, "scenario", acc.SCENARIOS[1:])


@query("b10_scenario_differs")
def _(w: Workspace) -> DataFrame:
    return cents(
        expect.differs(w.sensitivity, "P003_SENSITIVITY", "PRIMARY", "total_tiv"),
        "observed", "expected")


@query("b11_load_profile")
def _(w: Workspace) -> DataFrame:
    return expect.profile(w.portfolio, "row_id", "tiv_total")


@query("b11_checks_while_writing")
def _(w: Workspace) -> DataFrame:
    orders = tables.read_table(w.spark, f"{w.sf_dir}/orders.parquet")
    watch = expect.Watch().row_count(orders.count()).no_nulls("latitude").no_nulls("tiv_total").positive("tiv_total")
    tables.materialise(watch.on(w.portfolio), "watched")
    return watch.table(w.spark)


@query("b12_priority_counts")
def _(w: Workspace) -> DataFrame:
    return expect.counts(w.scores, ["priority"])


@query("b12_axis_counts")
def _(w: Workspace) -> DataFrame:
    return expect.counts(
        w.scores, ["affects_hazard", "affects_vulnerability", "affects_financial"])


@query("b13_declared_keys")
def _(w: Workspace) -> DataFrame:
    return (
        expect.unique(w.scores, ["row_id", "rule_id"])
        .unionByName(expect.foreign_key(w.flags, w.catalogue, ["rule_id"]))
        .unionByName(expect.unique(w.cleansed, ["row_id"]))
    )


# ------------------------------------------------------------- E calibration

@query("e01_density_threshold")
def _(w: Workspace) -> DataFrame:
    return calibrate.calibrate_density(w.clean)


@query("e02_building_tiv_threshold")
def _(w: Workspace) -> DataFrame:
    return calibrate.calibrate_building_tiv(w.clean)


@query("e02_sketched_threshold")
def _(w: Workspace) -> DataFrame:
    """The exact median and whether the sketch's is as near in rank as it says."""
    value, where = F.col("tiv_building"), F.col("tiv_building") > 0
    exact = calibrate.calibrate_building_tiv(w.clean)
    sketch = calibrate.calibrate_sketched(w.clean, value, where).first()
    rank = w.clean.filter(where).agg(
        (F.count_if(value < sketch["median"]) / F.count("*")).alias("below"),
        (F.count_if(value <= sketch["median"]) / F.count("*")).alias("upto"))
    off = sketch["rank_error"]
    return exact.crossJoin(rank).select(  # one row each
        "reference_name", "median", "clean_max", F.round(F.lit(off), 6).alias("rank_error"),
        ((F.col("below") <= 0.5 + off) & (F.col("upto") >= 0.5 - off)).alias("within"),
        F.col("median").between(sketch["median_low"], sketch["median_high"]).alias("bracketed"))


@query("e03_reference_row")
def _(w: Workspace) -> DataFrame:
    table = calibrate.calibrate_building_tiv(w.portfolio).unionByName(
        calibrate.calibrate_building_tiv(w.clean, "other"))
    return tables.replace_keyed(table, calibrate.calibrate_building_tiv(w.clean), "reference_name")


@query("e04_materiality_reference")
def _(w: Workspace) -> DataFrame:
    return w.validated


# --------------------------------------------------------------- D detection

def _rule_query(number: int, rule_id: str, title: str) -> None:
    @query(f"d{number:02d}_{rule_id.lower().replace('-', '')}_{title}")
    def _(w: Workspace) -> DataFrame:
        return w.rule(rule_id)


for _n, _rule in enumerate(RULES, start=1):
    _rule_query(_n, _rule.rule_id, _rule.error_type.split("_", 1)[1])


@query("d40_detect_all")
def _(w: Workspace) -> DataFrame:
    return detect(w.portfolio, w.references())


@query("d40_flags_per_rule")
def _(w: Workspace) -> DataFrame:
    return detect(w.portfolio, w.references()).groupBy("rule_id").agg(F.count("*").alias("flags"))


# -------------------------------------------------------------- I evaluation

@query("i01_error_type_to_rule")
def _(w: Workspace) -> DataFrame:
    return w.truth.groupBy("error_type", "rule_id").agg(F.count("*").alias("events"))


@query("i02_distinct_pairs")
def _(w: Workspace) -> DataFrame:
    doubled = w.truth.select("row_id", "rule_id").unionByName(w.truth.select("row_id", "rule_id"))
    return evaluate.distinct_pairs(doubled)


@query("i03_confusion_per_rule")
def _(w: Workspace) -> DataFrame:
    return w.rule_counts.select("rule_id", "error_type", "TP", "FP", "FN")


@query("i04_precision_recall")
def _(w: Workspace) -> DataFrame:
    return w.rule_counts


@query("i05_overall")
def _(w: Workspace) -> DataFrame:
    return evaluate.overall(w.rule_counts)


@query("i05_summary_report")
def _(w: Workspace) -> DataFrame:
    return evaluate.summary_lines(w.rule_counts)


@query("i06_completeness_coverage")
def _(w: Workspace) -> DataFrame:
    return evaluate.completeness_coverage(w.rule_counts)


@query("i07_by_dimension")
def _(w: Workspace) -> DataFrame:
    return evaluate.by_dimension(w.rule_counts, w.truth)


# ------------------------------------------------------------- M materiality

@query("m01_materiality_tiv")
def _(w: Workspace) -> DataFrame:
    return materiality.materiality_tiv(w.portfolio, w.validated)


@query("m02_tiv_percentile")
def _(w: Workspace) -> DataFrame:
    return materiality.percentiles(w.materiality_tiv)


@query("m02_percentile_with_nulls")
def _(w: Workspace) -> DataFrame:
    return materiality.percentiles(
        w.portfolio.select("row_id", F.col("tiv_contents").alias("materiality_tiv")))


@query("m03_cells")
def _(w: Workspace) -> DataFrame:
    return w.cells()


@query("m04_cell_baseline")
def _(w: Workspace) -> DataFrame:
    return materiality.cell_baseline(w.cells())


@query("m05_enriched_findings")
def _(w: Workspace) -> DataFrame:
    return materiality.enriched_findings(
        w.flags, w.portfolio, w.validated, w.catalogue, w.percentile)


@query("m06_rule_totals")
def _(w: Workspace) -> DataFrame:
    return materiality.rule_totals(w.findings)


@query("m07_rule_cells")
def _(w: Workspace) -> DataFrame:
    return materiality.rule_cells(w.findings)


@query("m08_spatial_enrichment")
def _(w: Workspace) -> DataFrame:
    return materiality.concentration(w.findings, w.cells()).withColumn(
        "enrichment_ratio", r10("enrichment_ratio"))


@query("m09_decision_flag")
def _(w: Workspace) -> DataFrame:
    return w.scores.groupBy("rule_id", "changes_decision").agg(F.count("*").alias("flags"))


@query("m10_priority")
def _(w: Workspace) -> DataFrame:
    return w.scores.groupBy("rule_id", "priority").agg(F.count("*").alias("flags"))


@query("m11_scores")
def _(w: Workspace) -> DataFrame:
    return materiality.scores(w.findings, w.concentration)


@query("m12_funnel")
def _(w: Workspace) -> DataFrame:
    return materiality.funnel(w.portfolio, w.scores, w.validated)


# --------------------------------------------------------------- T treatment

@query("t01_findings_with_priority")
def _(w: Workspace) -> DataFrame:
    return treat.findings_with_priority(w.flags, w.scores)


@query("t02_actions")
def _(w: Workspace) -> DataFrame:
    return w.actions().groupBy("rule_id", "action", "method").agg(F.count("*").alias("findings"))


def _apply(w: Workspace) -> DataFrame:
    return treat.apply(w.portfolio, treat.per_record(w.actions()))


@query("t03_original_and_clean")
def _(w: Workspace) -> DataFrame:
    names = [f"{f}_{s}" for f in treat.FIELDS for s in ("orig", "clean")]
    return _apply(w).select("row_id", *names)


@query("t04_fix_swapped")
def _(w: Workspace) -> DataFrame:
    return _apply(w).filter("treatment_rule LIKE '%G-002%'").select(
        "row_id", "latitude_orig", "longitude_orig", "latitude_clean", "longitude_clean")


@query("t05_fix_free_text")
def _(w: Workspace) -> DataFrame:
    return _apply(w).filter(
        "treatment_rule LIKE '%K-001%' AND treatment_rule NOT LIKE '%K-003%'").select(
        "row_id", "construction_orig", "construction_clean")


@query("t06_fix_numeric_codes")
def _(w: Workspace) -> DataFrame:
    return _apply(w).filter("treatment_rule LIKE '%K-003%'").select(
        "row_id", "construction_orig", "construction_clean")


@query("t07_fix_currency")
def _(w: Workspace) -> DataFrame:
    return _apply(w).filter("treatment_rule LIKE '%K-004%'").select(
        "row_id", "currency_orig", "currency_clean")


@query("t08_fix_negative")
def _(w: Workspace) -> DataFrame:
    return _apply(w).filter("treatment_rule LIKE '%V-001%'").select(
        "row_id", "tiv_total_orig", "tiv_total_clean", "tiv_total")


def _records_with(name: str, column: str) -> None:
    @query(name)
    def _(w: Workspace) -> DataFrame:
        return treat.per_record(w.actions()).filter(column).select("row_id", "treatment_method")


_records_with("t09_quarantined", "quarantined")
_records_with("t10_referred", "referred")
_records_with("t11_assumed", "assumed")


@query("t12_audit_strings")
def _(w: Workspace) -> DataFrame:
    return treat.per_record(w.actions()).select(
        "row_id", "treatment_rule", "classification", "priority", "treatment_method")


@query("t13_outcome")
def _(w: Workspace) -> DataFrame:
    return _apply(w).select("row_id", "treatment_applied", "quarantined", "referred")


@query("t14_cleansed")
def _(w: Workspace) -> DataFrame:
    return treat.treat(w.portfolio, w.flags, w.catalogue, w.scores)


@query("t15_treatment_summary")
def _(w: Workspace) -> DataFrame:
    return treat.summary(w.cleansed)


@query("t15_classification_summary")
def _(w: Workspace) -> DataFrame:
    return treat.summary(w.cleansed, "classification")


# ----------------------------------------------------------------- S spatial

@query("s01_points")
def _(w: Workspace) -> DataFrame:
    return w.portfolio.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        "row_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))


@query("s02_point_in_polygon")
def _(w: Workspace) -> DataFrame:
    rows = w.portfolio.select("row_id", "longitude", "latitude")
    return spatial.polygons_at(rows, w.land, "longitude", "latitude", "inside").select(
        "row_id", F.explode("inside").alias("poly_id"))


@query("s03_covered_by_polygon")
def _(w: Workspace) -> DataFrame:
    # as they are, and snapped to half degrees, so that many points lie on boundaries
    rows = w.portfolio.filter("latitude IS NOT NULL").select(
        "row_id", "longitude", "latitude", (F.round(F.col("longitude") * 2, 0) / 2).alias("x"),
        (F.round(F.col("latitude") * 2, 0) / 2).alias("y"))
    names = {"": ("longitude", "latitude"), "snapped_": ("x", "y")}
    for prefix, (x, y) in names.items():
        rows = spatial.polygons_at(rows, w.land, x, y, f"{prefix}covered_by", closed=True)
        rows = spatial.polygons_at(rows, w.land, x, y, f"{prefix}within")
    return rows.select("row_id", *[
        F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
        for p in names for c in (f"{p}covered_by", f"{p}within")])


@query("s04_nearest_point")
def _(w: Workspace) -> DataFrame:
    rows = w.portfolio.select("row_id", "longitude", "latitude")
    return spatial.nearest_point(rows, w.grid, "longitude", "latitude").select(
        "row_id", "grid_lon", "grid_lat")


@query("s05_nearest_within_radius")
def _(w: Workspace) -> DataFrame:
    rows = w.portfolio.select("row_id", "longitude", "latitude")
    return spatial.nearest_point(rows, w.grid, "longitude", "latitude", acc.RADIUS).select(
        "row_id", "grid_lon", "grid_lat")


# ------------------------------------------------- U accumulation, L linkage

@query("u01_critical_referred")
def _(w: Workspace) -> DataFrame:
    return acc.critical_referred(w.cleansed, w.flags)


@query("u02_dirty_accumulation")
def _(w: Workspace) -> DataFrame:
    return acc.dirty(w.portfolio, w.grid)


@query("u03_cleansed_accumulation")
def _(w: Workspace) -> DataFrame:
    return acc.cleansed_points(acc.place(w.usable, w.grid))


@query("u04_fallback_accumulation")
def _(w: Workspace) -> DataFrame:
    return acc.with_fallback(w.placed, w.usable, w.grid, derived.fallback_points(w.spark))


@query("u05_fallback_comparison")
def _(w: Workspace) -> DataFrame:
    compared = acc.fallback_comparison(w.clean_points, w.fallback_points).withColumn(
        "top10_tiv_share_pct", r10("top10_tiv_share_pct"))
    return cents(compared, "portfolio_tiv", "top10_tiv", "assumed_tiv")


def _both(w: Workspace) -> DataFrame:
    return acc.both_statuses(w.dirty_points, w.clean_points)


@query("u06_accumulation_summary")
def _(w: Workspace) -> DataFrame:
    return cents(acc.totals(_both(w)), "portfolio_tiv")


@query("u07_top_cells")
def _(w: Workspace) -> DataFrame:
    return acc.top_points(_both(w)).withColumn("tiv_rank", F.col("tiv_rank").cast("long"))


def _rounded(df: DataFrame) -> DataFrame:
    shares = ("top1_share", "top3_share", "top5_share", "hhi")
    return cents(df.withColumns({c: r10(c) for c in shares}), "portfolio_tiv")


@query("u08_concentration")
def _(w: Workspace) -> DataFrame:
    return _rounded(acc.concentration(w.clean_points))


@query("u09_sensitivity")
def _(w: Workspace) -> DataFrame:
    return acc.sensitivity(acc.place(w.usable, w.grid))


@query("u10_sensitivity_summary")
def _(w: Workspace) -> DataFrame:
    return cents(acc.sensitivity_summary(w.sensitivity), "spatial_tiv")


def _comparison(w: Workspace) -> DataFrame:
    return acc.comparison(w.dirty_points, w.clean_points).withColumn(
        "tiv_change_pct", r10("tiv_change_pct"))


@query("u11_dirty_vs_cleansed")
def _(w: Workspace) -> DataFrame:
    return _comparison(w)


@query("u12_largest_changes")
def _(w: Workspace) -> DataFrame:
    return acc.largest_changes(_comparison(w))


@query("u13_by_district")
def _(w: Workspace) -> DataFrame:
    return acc.by_attribute(w.portfolio, w.usable, "district", "district")


@query("u14_by_occupancy")
def _(w: Workspace) -> DataFrame:
    return acc.by_attribute(w.portfolio, w.usable, "occupancy_code", "occupancy_code")


@query("u15_by_construction")
def _(w: Workspace) -> DataFrame:
    return acc.by_attribute(w.portfolio, w.usable, "construction_code", "construction_clean")


@query("u16_impact_summary")
def _(w: Workspace) -> DataFrame:
    return _rounded(acc.impact_summary(w.scenario_points()))


def audit_inputs(w: Workspace) -> Inputs:
    """What a run over the derived portfolio starts from."""
    return Inputs(
        portfolio=w.portfolio, clean=w.clean, postcodes=derived.postcodes(w.spark),
        land=derived.land_edges(w.spark), country=derived.country_edges(w.spark),
        grid=w.aal.withColumn("value", F.col("project1_tiv")),
        fallback=derived.fallback_points(w.spark), aal=w.aal, truth=derived.ground_truth_of(w.marked),
        district_cities=derived.DISTRICT_CITIES, as_of_year=AS_OF_YEAR)


@query("audit_run")
def _(w: Workspace) -> DataFrame:
    done = run_audit(audit_inputs(w), f"{tables.shared_dir(w.spark)}/audit-{uuid.uuid4().hex}")
    return _rounded(done["accumulation_impact_summary"])


@query("l01_grid_check")
def _(w: Workspace) -> DataFrame:
    """The exposure grid against two AAL grids, all read from files: that of the same run, and one of other values."""
    folder = f"{tables.shared_dir(w.spark)}/grids-{uuid.uuid4().hex}"

    def written(name: str, grid: DataFrame) -> str:
        tables.write_csv(grid, f"{folder}/{name}")
        return f"{folder}/{name}"

    value = F.col("total_tiv").alias("value")
    grid = points.read_grid(w.spark, written("exposure", w.dirty_points.select("grid_lon", "grid_lat", value)))
    aal = F.col("value") * 0.01
    same = points.read_aal_grid(w.spark, written("aal", grid.orderBy("value").withColumn("aal", aal)))
    other = points.read_aal_grid(w.spark, written(
        "other", w.clean_points.select("grid_lon", "grid_lat", value).withColumn("aal", aal)))
    return linkage.check_grids(grid, same).withColumn("grid", F.lit("same")).unionByName(
        linkage.check_grids(grid, other).withColumn("grid", F.lit("other")))


@query("l02_scenario_stack")
def _(w: Workspace) -> DataFrame:
    return linkage.scenario_stack(w.scenario_points())


@query("l03_cell_linkage")
def _(w: Workspace) -> DataFrame:
    return linkage.link(w.scenario_points(), w.aal)


@query("l03_linkage_checks")
def _(w: Workspace) -> DataFrame:
    return linkage.check_link(w.scenario_points(), w.aal)


@query("l04_scenario_summary")
def _(w: Workspace) -> DataFrame:
    ratios = ("aal_to_tiv", "aal_multiple_vs_project1", "aal_change_vs_project1_pct")
    summary = linkage.scenario_summary(linkage.link(w.scenario_points(), w.aal), w.aal)
    return cents(summary.withColumns({c: r10(c) for c in ratios}), "portfolio_tiv", "linked_aal")


# ---------------------------------------------------------------- J corruption

@query("j00_selection")
def _(w: Workspace) -> DataFrame:
    kinds = F.array(*[
        F.when(corrupt.has(t.name.split("_")[0]), F.lit(t.name)) for t in corrupt.TYPES])
    return w.selected.select("row_id", F.explode(kinds).alias("error_type")).filter(
        "error_type IS NOT NULL")


@query("j01_ground_truth")
def _(w: Workspace) -> DataFrame:
    return w.events


@query("j02_injection_log")
def _(w: Workspace) -> DataFrame:
    return corrupt.injection_log(w.selected, w.copies.count())


@query("j03_apply_edits")
def _(w: Workspace) -> DataFrame:
    return corrupt.apply_errors(w.selected, w.places).drop("__mask")


@query("j03_duplicate_rows")
def _(w: Workspace) -> DataFrame:
    return corrupt.duplicate_rows(w.corrupted).select("row_id", "source_row_id", "location_id")


def _edits_query(dimension: str) -> None:
    @query(f"j03_{dimension.lower()}_edits")
    def _(w: Workspace) -> DataFrame:
        return w.events.filter(F.col("dimension") == dimension).select(
            "row_id", "error_type", "classification", "original_value", "corrupted_value")


for _dimension in sorted({t.dimension for t in corrupt.TYPES}):
    _edits_query(_dimension)


@query("j04_weighted_draw")
def _(w: Workspace) -> DataFrame:
    cells = w.cells().groupBy("cell_x", "cell_y").agg(F.count("*").alias("weight"))
    intervals = sampling.weight_intervals(cells, sampling.cell_order("cell_x", "cell_y"), "weight")
    return sampling.draw(w.portfolio.select("row_id"), "row_id", intervals, 42, "cell").select(
        "row_id", "cell_x", "cell_y")
