"""Published totals recomputed from published cell and rule figures."""

import pytest
from pyspark.sql import functions as F

from tivlens.model import DIMENSIONS, catalogue
from tivlens.operators import accumulate, evaluate, linkage

# grid_lon, grid_lat, total_tiv, project1_tiv, project1_aal.
DIRTY = [
    (86.75, 19.0, 2931413375.755332, 0.0, 0.0),
    (85.25, 19.75, 51526596308.26499, 650163507.6805493, 14147063.405860184),
    (85.5, 19.75, 368591758.9861708, 45139115.91705292, 971578.0186966084),
    (85.5, 20.0, 2403155121.2929945, 885900532.07508, 13867776.767731184),
    (85.75, 20.0, 2956920950.5013175, 1198124994.175862, 20436538.46461382),
    (86.0, 20.0, 2412004439.787553, 821844044.3449426, 14936190.615924742),
    (86.25, 20.0, 259962680.98659974, 168142040.36203867, 2642898.1901759305),
    (85.5, 20.25, 3405684546.790189, 943572265.8860967, 10687242.682833167),
    (85.75, 20.25, 325211411033.5983, 20685660874.15178, 271052269.61240673),
    (86.0, 20.25, 64330109852.10377, 6429632199.380755, 95282239.37929),
    (86.25, 20.25, 2082146667.5521271, 977452427.066609, 12817758.885202343),
    (86.5, 20.25, 21022159573.80592, 1828339705.4505537, 21362903.04239067),
    (85.0, 20.5, 89591436.45831636, 40162086.59299868, 338887.25258487434),
    (85.25, 20.5, 44497210174.74884, 189565711.13036367, 1428134.8454842926),
    (85.5, 20.5, 1492183166.5002584, 934621994.6603694, 7719782.8622219255),
    (85.75, 20.5, 778347116511.5612, 7990105670.344791, 71714050.13945653),
    (86.0, 20.5, 93999623349.34059, 10481361708.153227, 116006476.57406203),
    (86.25, 20.5, 68068190822.53097, 1958725866.953657, 19414075.96347512),
]
REFERENCE_AAL = 1532647372.2478
# Rule, true positives, false positives, false negatives.
RULES = [
    ("C-001", 403, 0, 0), ("C-002", 1507, 0, 0), ("C-003", 2007, 0, 0), ("C-004", 1253, 0, 0),
    ("C-005", 603, 0, 0), ("C-006", 752, 0, 0), ("C-007", 250, 0, 0), ("D-001", 20, 0, 0),
    ("D-002", 75, 467, 0), ("D-003", 51, 0, 0), ("D-004", 15, 15, 0), ("G-001", 60, 66, 0),
    ("G-002", 30, 0, 0), ("G-003", 10, 0, 0), ("G-004", 15, 101, 0), ("G-005", 301, 0, 0),
    ("K-001", 751, 252, 0), ("K-002", 404, 0, 0), ("K-003", 252, 0, 0), ("K-004", 101, 0, 0),
    ("P-001", 25, 16, 0), ("P-002", 152, 15, 0), ("P-003", 1, 1, 0), ("P-004", 252, 0, 0),
    ("P-005", 184, 54, 17), ("V-001", 15, 0, 0), ("V-002", 75, 0, 0), ("V-003", 10, 0, 0),
    ("V-004", 20, 0, 0), ("V-005", 10, 0, 0), ("V-006", 25, 0, 0), ("V-007", 40, 12, 0),
    ("X-001", 30, 1, 0), ("X-002", 20, 3, 0), ("X-003", 15, 11, 0), ("X-004", 15, 1, 0),
    ("X-005", 58, 38, 2), ("X-006", 100, 0, 0), ("X-007", 75, 0, 0),
]
# End of fixed values.


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [("DIRTY", *r[:3]) for r in DIRTY],
        "scenario string, grid_lon double, grid_lat double, total_tiv double")


@pytest.fixture(scope="module")
def aal(spark):
    # one more cell brings the reference grid to its published total
    rest = REFERENCE_AAL - sum(r[4] for r in DIRTY)
    return spark.createDataFrame(
        [(r[0], r[1], r[3], r[4]) for r in DIRTY] + [(84.0, 18.0, 1e9, rest)],
        "grid_lon double, grid_lat double, project1_tiv double, project1_aal double")


def test_linked_aal(points, aal):
    linked = linkage.link(points, aal)
    assert linked.filter("grid_lat = 19.0").first()["linked_aal"] == 0.0
    row = linkage.scenario_summary(linked, aal).first()
    assert row["grid_cells"] == 18
    assert row["portfolio_tiv"] == pytest.approx(1465404071770.5654, rel=1e-12)
    assert row["linked_aal"] == pytest.approx(15840586933.949131, rel=1e-12)
    assert row["aal_to_tiv"] == pytest.approx(0.010809705827287514, rel=1e-12)
    assert row["aal_multiple_vs_project1"] == pytest.approx(10.335441289875567, rel=1e-10)
    assert row["aal_change_vs_project1_pct"] == pytest.approx(933.5441289875566, rel=1e-10)


def test_concentration(points):
    row = accumulate.impact_summary(points).first()
    assert row["top1_share"] == pytest.approx(0.53114846035000304, rel=1e-12)
    assert row["top3_share"] == pytest.approx(0.81722043357471897, rel=1e-12)
    assert row["top5_share"] == pytest.approx(0.90756978036933058, rel=1e-12)
    assert row["hhi"] == pytest.approx(0.341955565567035648, rel=1e-12)
    assert row["occupied_cells"] == 18


def test_detection_metrics(spark):
    counts = spark.createDataFrame(RULES, "rule_id string, TP long, FP long, FN long")
    overall = {r["scope"]: r for r in evaluate.overall(counts).collect()}
    assert (overall["all"]["TP"], overall["all"]["FP"], overall["all"]["FN"]) == (9982, 1053, 19)
    assert overall["all"]["precision"] == pytest.approx(0.90457635, abs=5e-9)
    assert overall["all"]["recall"] == pytest.approx(0.99810019, abs=5e-9)
    assert overall["completeness_excluded"]["precision"] == pytest.approx(0.75281690, abs=5e-9)
    coverage = evaluate.completeness_coverage(counts).first()
    assert (coverage["TP"], coverage["coverage"]) == (6775, 1.0)
    truth = counts.select("rule_id", *[
        F.coalesce(*[F.when(F.col("rule_id").startswith(k), F.lit(v)) for k, v in DIMENSIONS.items()])
        .alias("dimension")])
    rows = evaluate.by_dimension(counts, truth).collect()
    assert [(r["dimension"], r["TP"], r["FP"], r["FN"]) for r in rows] == [
        ("Completeness", 6775, 0, 0), ("Validity", 195, 12, 0), ("Consistency", 313, 54, 2),
        ("Duplication", 161, 482, 0), ("Geography", 416, 167, 0), ("Coding", 1508, 252, 0),
        ("Plausibility", 614, 86, 17)]
    lines = [r["line"] for r in evaluate.summary_lines(counts).orderBy("position").collect()]
    assert "Precision: 90.457635%" in lines and "Recall: 99.411035%" in lines
    assert lines[-1] == "Coverage: 100.000000%"


def test_catalogue(spark):
    cat = catalogue(spark)
    assert cat.count() == 39
    axes = cat.selectExpr(
        "count_if(affects_hazard)", "count_if(affects_vulnerability)", "count_if(affects_financial)")
    assert tuple(axes.first()) == (9, 15, 15)
    assert {r["action"]: r["count"] for r in cat.groupBy("action").count().collect()} == {
        "FIXED": 5, "QUARANTINED": 5, "ASSUMED": 3, "REFERRED": 26}
