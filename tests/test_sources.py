"""Scans that keep what doesn't parse, boundaries read feature by feature, and draws of any size."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from tivlens.model import PORTFOLIO
from tivlens.operators import detect, expect, sampling
from tivlens.sources import geojson, tables

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("year", T.IntegerType()), T.StructField("value", T.DoubleType())])


def csv(tmp_path, *lines):
    path = tmp_path / "t.csv"
    path.write_text("row_id,name,year,value\n" + "\n".join(lines) + "\n")
    return str(path)


def test_malformed_fields_and_lines(spark, tmp_path):
    path = csv(tmp_path, "1,a,1990,2.5", "2,b,19x5,2.5", "3,c,,", '4,"d, e",12O0,1e3', "5,f,1990", "6,g,1990,1.0,surplus",
               "7,h, 1991 ,NaN", "x8,,2000,--")
    rows = {r["row_id"]: r for r in tables.read_csv(spark, path, SCHEMA, errors="keep").collect()}
    wrong = {k: [tuple(m) for m in r["malformed"]] for k, r in rows.items()}
    assert wrong[1] == wrong[3] == wrong[7] == []
    assert wrong[2] == [("year", "19x5")] and wrong[4] == [("year", "12O0")]
    assert wrong[None] == [("row_id", "x8"), ("value", "--")]
    assert (rows[2]["year"], rows[4]["name"], rows[4]["value"], rows[7]["year"]) == (None, "d, e", 1000.0, 1991)
    assert {k for k, r in rows.items() if r["bad_record"]} == {5, 6}
    checks = {r["check"]: r for r in expect.well_formed(tables.read_csv(spark, path, SCHEMA, errors="keep")).collect()}
    assert checks["fields_well_formed"]["observed"] == 4 and checks["records_well_formed"]["observed"] == 2
    with pytest.raises(tables.MalformedInput, match="4 fields and 2 lines"):
        tables.read_csv(spark, path, SCHEMA, errors="fail")
    good = csv(tmp_path, "1,a,1990,2.5", "3,c,,")
    assert tables.read_csv(spark, good, SCHEMA, errors="fail").collect() == tables.read_csv(spark, good, SCHEMA).collect()
    assert all(r["ok"] for r in expect.well_formed(tables.read_csv(spark, good, SCHEMA, errors="keep")).collect())


def test_malformed_is_not_missing(spark, tmp_path):
    names = [f.name for f in PORTFOLIO.fields]

    def line(**own):
        return ",".join(str(own.get(n, "")) for n in names)

    path = tmp_path / "p.csv"
    path.write_text(",".join(names) + "\n" + "\n".join([
        line(row_id=1, year_built="19x5", num_storeys=3), line(row_id=2, num_storeys="12O0", year_built=1990),
        line(row_id=3), line(row_id=4, year_built=1990, num_storeys=2, latitude="20,5".replace(",", ";"))]) + "\n")
    back = tables.read_csv(spark, str(path), PORTFOLIO, errors="keep")
    flags = {(r["row_id"], r["rule_id"]) for r in detect.detect(back, detect.References()).collect()}
    assert {(3, "C-003"), (3, "C-004"), (3, "C-001"), (1, "C-001")} <= flags
    assert not {(1, "C-003"), (2, "C-004"), (4, "C-001")} & flags


def collection(features, indent=None, order=("type", "properties", "geometry")):
    return json.dumps({"type": "FeatureCollection", "name": "x", "features": [
        {k: f[k] for k in order} for f in features], "bbox": [0, 0, 1, 1]}, indent=indent)


def square(x, name, **more):
    ring = [[x, 0], [x, 1], [x + 1, 1], [x + 1, 0], [x, 0]]
    return {"type": "Feature", "properties": {"NAME": name, **more}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


@pytest.mark.parametrize("indent", [None, 2])
def test_features_are_rows_of_several_tasks(spark, tmp_path, indent):
    features = [square(i, f"n{i % 7}", note="a } , { \"type\": b ] }", list=[{"k": 1}]) for i in range(300)]
    path = tmp_path / "b.json"
    path.write_text(collection(features, indent))
    split = geojson.split_features(spark, str(path))
    assert split is not None and split.count() == 300
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        assert geojson.split_features(spark, str(path)).rdd.getNumPartitions() > 3
        edges = geojson.read_boundaries(spark, str(path), "NAME", {"n3": "three"})
        assert edges.count() == 4 * len([f for f in features if f["properties"]["NAME"] == "n3"])
        bare = F.regexp_replace("feature.geometry.coordinates", r"\s|\.0", "")
        whole = geojson._whole_file(spark, str(path)).select(bare)
        assert geojson.split_features(spark, str(path)).select(bare).exceptAll(whole).count() == 0
    finally:
        spark.conf.set(key, before)


def test_other_layouts_are_read_whole(spark, tmp_path):
    path = tmp_path / "b.json"
    for text in (collection([square(i, "n") for i in range(5)], order=("properties", "geometry", "type")),
                 collection([square(i, "Feature") for i in range(5)])):
        path.write_text(text)
        assert geojson.split_features(spark, str(path)) is None
        assert geojson.read_boundaries(spark, str(path), "NAME").count() == 20
    path.write_text(collection([]))
    assert geojson.read_boundaries(spark, str(path), "NAME").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_rows", [10**6, 0])
def test_draws_follow_intervals(spark, max_rows):
    weights = [1, 0, 5, 1, 100_000, 3] + [1] * 300
    cells = spark.createDataFrame([(i % 9 - 4, i // 9, w) for i, w in enumerate(weights)], "cell_x long, cell_y long, weight long")
    intervals = sampling.weight_intervals(cells, sampling.cell_order("cell_x", "cell_y"), "weight", buckets=7)
    ordered = sorted((r["cell_x"], r["cell_y"], r["weight"]) for r in cells.collect() if r["weight"])
    upto, total = 0, sum(weights)
    got = {(r["cell_x"], r["cell_y"]): (r["low"], r["high"]) for r in intervals.collect()}
    for x, y, w in ordered:
        assert got[x, y] == (upto / total, (upto + w) / total)
        upto += w
    drawn = sampling.draw(spark.range(5000).withColumnRenamed("id", "row_id"), "row_id", intervals, 42, "cell", max_rows)
    rows = drawn.collect()
    assert len(rows) == 5000 and all(r["low"] <= r["u"] < r["high"] for r in rows)
    hot = Counter((r["cell_x"], r["cell_y"]) for r in rows)[4 % 9 - 4, 0]
    assert math.isclose(hot / 5000, 100_000 / total, abs_tol=0.01)


def test_draws_cost_the_same_for_any_number_of_cells(spark):
    """No window over all cells, and two listed cells per slot on average, however weights are spread."""
    for n, weight in ((50, "1"), (5000, "1"), (5000, "CASE WHEN id = 7 THEN 1000000 ELSE 1 END")):
        cells = spark.range(n).selectExpr("id AS cell_x", "0L AS cell_y", f"{weight} AS weight")
        intervals = sampling.weight_intervals(cells, sampling.cell_order("cell_x", "cell_y"), "weight")
        wide = [x for x in plan(intervals).split("\n") if "Window" in x and "cell_x" in x and "__bucket" not in x]
        assert wide == []
        size = F.least(F.floor(F.col("high") * n), F.lit(n - 1)) - F.floor(F.col("low") * n) + 1
        assert intervals.agg(F.sum(size)).first()[0] <= 2 * n
    empty = sampling.weight_intervals(cells.limit(0), sampling.cell_order("cell_x", "cell_y"), "weight")
    assert sampling.draw(spark.range(5).withColumnRenamed("id", "row_id"), "row_id", empty, 1, "x").count() == 0


def test_replacing_in_place_leaves_other_files(spark, tmp_path):
    path, folder = f"{tmp_path}/t", tmp_path / "t"
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    tables.store_keyed(rows, path, "k", 16)
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    new = spark.createDataFrame([(7, "new"), (7, "twice"), (1000, "added")], "k long, v string")
    tables.replace_in_place(spark, path, new, "k", 16)
    got = Counter((r["k"], r["v"]) for r in tables.read_keyed(spark, path).collect())
    want = Counter((k, "old") for k in range(400) if k != 7) + Counter([(7, "new"), (7, "twice"), (1000, "added")])
    assert got == want
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    kept = [p for p in before if after.get(p) == before[p]]
    assert len({p.parent for p in before} - {p.parent for p in kept}) <= 2 and len(kept) >= len(before) - 2
    tables.replace_in_place(spark, path, new.limit(0), "k", 16)
    assert {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")} == after


def test_checks_are_measured_while_writing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "k long, v double")
    watch = expect.Watch().row_count(3).no_nulls("k").no_nulls("v").positive("v")
    tables.materialise(watch.on(df), "w", "k")
    assert [(n, ok, o) for n, ok, o, _ in watch.results()] == [
        ("row_count", True, 3.0), ("k_not_null", True, 0.0), ("v_not_null", False, 1.0), ("v_positive", False, 1.0)]
    with pytest.raises(expect.ContractError, match="v_not_null: observed 1.*v_positive"):
        watch.enforce()
    plain = expect.no_nulls(df, "v").unionByName(expect.positive(df, "v")).collect()
    assert [tuple(r) for r in plain] == watch.results()[2:]
    empty = expect.Watch().row_count(0).positive("v")
    tables.materialise(empty.on(df.limit(0)), "w")
    empty.enforce()


def test_sketched_threshold_on_a_large_column(spark):
    from tivlens.operators import calibrate

    df = spark.range(200_000).select((F.pow(F.col("id") % 9973, 2) + 1.0).alias("v"))
    got = calibrate.calibrate_sketched(df, F.col("v"), F.lit(True)).first()
    exact = calibrate.calibrate(df, F.col("v"), F.lit(True)).first()
    assert got["clean_max"] == exact["clean_max"] and got["median_low"] <= exact["median"] <= got["median_high"]
    below = df.filter(F.col("v") < got["median"]).count() / 200_000
    assert abs(below - 0.5) <= got["rank_error"] < 0.02
