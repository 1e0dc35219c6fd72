"""Whole runs, sources, contracts, corruption and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tivlens.model import PORTFOLIO, catalogue
from tivlens.operators import calibrate, corrupt, detect, evaluate, expect, treat
from tivlens.plans.audit import Inputs, run_audit
from tivlens.registry.workspace import workspace
from tivlens.sources import derived, geojson, points, tables
from tivlens.streaming.row_flags import flag_stream, write_flags

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return workspace(spark, SF_DIR)


def test_audit_run(spark, w, tmp_path):
    grid = w.aal.withColumn("value", F.col("project1_tiv"))
    done = run_audit(Inputs(
        portfolio=w.portfolio, clean=w.clean, postcodes=derived.postcodes(spark),
        land=derived.land_edges(spark), country=derived.country_edges(spark), grid=grid,
        fallback=derived.fallback_points(spark), aal=w.aal,
        truth=derived.ground_truth_of(w.marked),
        district_cities=derived.DISTRICT_CITIES, as_of_year=2026), str(tmp_path))
    rows = w.portfolio.count()
    assert done["portfolio_cleansed"].count() == rows
    assert sum(r["count"] for r in done["treatment_summary"].collect()) == rows
    assert done["quality_flags"].count() == w.flags.count()
    tiv = {r["scenario"]: r["portfolio_tiv"] for r in done["accumulation_impact_summary"].collect()}
    assert tiv["PRIMARY"] <= tiv["P001_SENSITIVITY"] <= tiv["COMBINED_SENSITIVITY"]
    for r in done["accumulation_impact_summary"].collect():
        assert 0 < r["top1_share"] <= r["top3_share"] <= r["top5_share"] <= 1
        assert r["hhi"] >= 1 / r["occupied_cells"]


def test_clean_rows_raise_no_local_flags(spark, w):
    refs = detect.References(
        density=w.density, building_tiv=w.building_tiv, postcodes=derived.postcodes(spark),
        district_cities=derived.DISTRICT_CITIES, land=w.land, country=w.country, as_of_year=2026)
    found = {r["rule_id"] for r in detect.detect(w.clean, refs).select("rule_id").distinct().collect()}
    assert found <= {"D-002", "D-004"}  # the small key space repeats ids and points


def _row(spark, **changes):
    base = {f.name: None for f in PORTFOLIO.fields} | {"row_id": 1, "location_id": "L", "account_id": "A"}
    return base | changes


def test_null_and_blank_edges(spark):
    rows = [
        _row(spark, row_id=1, construction_code="  ", latitude=-0.0, longitude=0.0, tiv_total=5.0),
        _row(spark, row_id=2, construction_code=" Timber ", num_storeys=9, city=None, district="puri"),
        _row(spark, row_id=3, city="X", district="Puri", latitude=95.0),
        _row(spark, row_id=4, floor_area_sqm=0.0, tiv_building=10.0),
        _row(spark, row_id=5), _row(spark, row_id=6), _row(spark, row_id=7),
    ]
    df = spark.createDataFrame([tuple(r[f.name] for f in PORTFOLIO.fields) for r in rows], PORTFOLIO)
    refs = detect.References(
        density=detect.Threshold(1.0, 1, 1.0), building_tiv=detect.Threshold(1.0, 1, 9.0))
    flags = {(r["row_id"], r["rule_id"]) for r in detect.detect(df, refs).collect()}
    assert {(1, "C-002"), (1, "G-003"), (2, "X-001"), (3, "X-007"), (3, "V-003"), (4, "P-001"),
            (1, "P-003"), (6, "D-001"), (7, "D-001")} <= flags
    assert not {(2, "X-007"), (4, "X-005"), (5, "D-001"), (2, "C-002"), (2, "K-001")} & flags
    # row 4 has a value, the others of location L have none
    assert {r for r, rule in flags if rule == "D-004"} == {1, 2, 3, 4, 5, 6, 7}


def test_values_that_are_no_money(spark):
    odd = {11: 1e25, 12: float("nan"), 13: float("inf"), 14: -1e30, 15: 5.0}
    rows = [_row(spark, row_id=i, tiv_total=v, tiv_building=v, deductible=v, location_id=f"L{i}") for i, v in odd.items()]
    df = spark.createDataFrame([tuple(r[f.name] for f in PORTFOLIO.fields) for r in rows], PORTFOLIO)
    refs = detect.References(
        density=detect.Threshold(1.0, 1, 1.0), building_tiv=detect.Threshold(1.0, 1, 9.0))
    flags = {(r["row_id"], r["rule_id"]): r["flagged_value"] for r in detect.detect(df, refs).collect()}
    assert {(11, "P-001"), (13, "P-001"), (14, "V-001")} <= set(flags)
    assert "1.0E25" in flags[11, "P-001"] and "Infinity" in flags[13, "P-001"]
    lost = expect.money_fits(df, "tiv_total").first()
    assert (lost["ok"], lost["observed"]) == (False, 4.0)


def test_numeric_code_keeps_original(spark):
    rows = [_row(spark, row_id=1, construction_code="01"), _row(spark, row_id=2, construction_code="R.C.C.")]
    df = spark.createDataFrame([tuple(r[f.name] for f in PORTFOLIO.fields) for r in rows], PORTFOLIO)
    flags = detect.detect(df, detect.References(), {"K-001", "K-003"})
    got = {r["row_id"]: r for r in treat.treat(df, flags, catalogue(spark)).collect()}
    assert got[1]["construction_clean"] == "01" and got[2]["construction_clean"] == "RCC"
    assert got[1]["treatment_rule"] == "K-001;K-003" and got[1]["priority"] is None
    assert got[1]["treatment_applied"] == "FIXED"


def test_contracts(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "k long, v double")
    expect.enforce(expect.row_count(df, 2))
    with pytest.raises(expect.ContractError, match="k_unique.*v_not_null"):
        expect.enforce(expect.unique(df, ["k"]), expect.no_nulls(df, "v"))
    truth = spark.createDataFrame([(1, "Z9_nothing")], "row_id long, error_type string")
    with pytest.raises(expect.ContractError, match="Z9_nothing"):
        evaluate.require_mapped(truth)
    codes = spark.createDataFrame([(1,)], "k long")
    assert expect.all_mapped(df, codes, "k").first()["ok"]


def test_csv_and_points(spark, tmp_path):
    df = spark.createDataFrame([(85.123456789, -0.0, 5.0)], "grid_lon double, grid_lat double, value double")
    tables.write_csv(df, f"{tmp_path}/g")
    row = points.read_grid(spark, f"{tmp_path}/g").first()
    assert (row["grid_lon"], str(row["grid_lat"])) == (85.12345679, "0.0")
    tables.write_csv(df.withColumn("aal", F.lit(1.0)), f"{tmp_path}/a")
    assert "project1_aal" in points.read_aal_grid(spark, f"{tmp_path}/a").columns


def test_text_report(spark, w, tmp_path):
    tables.write_text(evaluate.summary_lines(w.rule_counts), f"{tmp_path}/report")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert lines[0] == "Detection evaluation summary" and len(lines) == 25


def test_keyed_replace_of_reference(spark, w):
    first = calibrate.calibrate_density(w.clean)
    again = tables.replace_keyed(first, first.withColumn("threshold", F.lit(1.0)), "reference_name")
    assert calibrate.read_threshold(again).threshold == 1.0 and again.count() == 1
    with pytest.raises(ValueError):
        calibrate.read_threshold(first, "missing")


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    moved = [[[x + 5, y] for x, y in square[0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME": "Old", "N": 1},
         "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"NAME": "Two"},
         "geometry": {"type": "MultiPolygon", "coordinates": [square, moved]}},
        {"type": "Feature", "properties": {"NAME": "Skipped"},
         "geometry": {"type": "Polygon", "coordinates": square}}]}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(doc, indent=1))
    edges = geojson.read_boundaries(spark, str(path), "NAME", {"Old": "New", "Two": "Two"})
    counts = {r["poly_id"]: r["count"] for r in edges.groupBy("poly_id").count().collect()}
    assert counts == {"New": 4, "Two": 8}
    assert edges.filter("x1 = 5 AND x2 = 6").count() == 1


def test_corruption(w):
    clean, dirty, copies = w.pristine, w.corrupted, w.copies
    n = clean.count()
    log = {r["rule"]: r for r in corrupt.injection_log(w.selected, copies.count()).collect()}
    assert len(log) == 39
    assert all(r["skipped"] == 0 for r in log.values())
    assert log["C3_missing_year_built"]["success"] == round(0.4 * n)
    truth = corrupt.ground_truth(clean, dirty, copies)
    events = truth.filter("row_id < 20000000 AND error_type NOT LIKE 'D1%'")
    # no record has a field claimed twice
    fields = {t.name: t.fields for t in corrupt.TYPES}
    claims = [(r["row_id"], f) for r in truth.collect() if r["error_type"] in fields
              for f in fields[r["error_type"]]]
    assert len(claims) == len(set(claims))
    assert copies.count() == round(0.004 * n) > 0
    top = clean.agg(F.max("row_id")).first()[0]
    assert sorted(r["row_id"] for r in copies.collect()) == [top + i + 1 for i in range(copies.count())]
    inherited = truth.filter(F.col("row_id") > top).groupBy("row_id").count().collect()
    assert all(r["count"] >= 2 for r in inherited) and events.count() > 0
    big = dirty.filter(corrupt.has("P3")).first()["tiv_total"]
    total = dirty.agg(F.sum(F.when(~corrupt.has("D4"), F.col("tiv_total")))).first()[0]
    assert big / total == pytest.approx(0.35, abs=0.01)
    again = corrupt.select_errors(clean).select("row_id", "__mask")
    assert again.exceptAll(w.selected.select("row_id", "__mask")).count() == 0


def test_detector_finds_injected_nulls(spark, w):
    flags = detect.detect(w.corrupted.drop("__mask"), detect.References(), {"C-002", "C-003", "V-004"})
    pairs = {(r["row_id"], r["rule_id"]) for r in flags.collect()}
    for short, rule in (("C2", "C-002"), ("C3", "C-003"), ("V4", "V-004")):
        assert {(r["row_id"], rule) for r in w.corrupted.filter(corrupt.has(short)).collect()} <= pairs


def test_stream_equals_batch(spark, w, tmp_path):
    source = f"{tmp_path}/in"
    tables.write_table(w.portfolio, source)
    refs = detect.References(density=w.density, building_tiv=w.building_tiv,
                             district_cities=derived.DISTRICT_CITIES, as_of_year=2026)
    stream = spark.readStream.schema(w.portfolio.schema).parquet(source)
    write_flags(flag_stream(stream, refs), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("row_id", "rule_id")
    rules = [r["rule_id"] for r in got.select("rule_id").distinct().collect()]
    want = w.flags.filter(F.col("rule_id").isin(rules)).select("row_id", "rule_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
