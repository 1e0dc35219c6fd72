"""A dirty test portfolio derived from the ``orders`` table, plus its reference data.

The derivation is plain SQL that reads the same in Spark and in other engines,
with integer arithmetic on the order key as its only source of variety.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

PORTFOLIO_SQL = (Path(__file__).parent / "derived_portfolio.sql").read_text()

#: The same portfolio before any corruption: no order has an error marker.
PRISTINE_SQL = PORTFOLIO_SQL.replace("o_orderkey % 1000", "999").replace("k = 516", "k = -516")

DISTRICT_CITIES = {"a": "aton", "b": "bton", "c": "cton", "d": "dton"}
#: District squares as (id, west, south).
LAND = [("A", 85.0, 20.0), ("B", 86.0, 20.0), ("C", 85.0, 21.0), ("D", 86.0, 21.0)]
#: Country rectangle as (west, south, east, north).
COUNTRY = (84.0, 19.5, 88.0, 23.0)

ERROR_CASE = """
CASE
 WHEN m >= 1000 THEN 'D1_exact_row_duplicate'
 WHEN m < 40 THEN 'C1_missing_coordinates'
 WHEN m < 140 THEN 'C2_missing_construction'
 WHEN m < 240 THEN 'C3_missing_year_built'
 WHEN m < 300 THEN 'C4_missing_storeys'
 WHEN m < 340 THEN 'C5_missing_contents'
 WHEN m < 380 THEN 'C6_missing_deductible'
 WHEN m < 410 THEN 'C7_missing_occupancy'
 WHEN m < 413 THEN 'V1_negative_tiv'
 WHEN m < 423 THEN 'V2_zero_tiv'
 WHEN m < 425 THEN 'V3_invalid_latitude'
 WHEN m < 429 THEN 'V4_future_year'
 WHEN m < 431 THEN 'V5_implausibly_old_year'
 WHEN m < 435 THEN 'V6_invalid_storeys'
 WHEN m < 441 THEN 'V7_deductible_gt_tiv'
 WHEN m < 447 THEN 'X1_timber_25_storeys'
 WHEN m < 451 THEN 'X2_rcc_1880'
 WHEN m < 454 THEN 'X3_residential_high_tiv'
 WHEN m < 457 THEN 'X4_warehouse_25_storeys'
 WHEN m < 467 THEN 'X5_floor_area_storey_mismatch'
 WHEN m < 482 THEN 'X6_postcode_district_mismatch'
 WHEN m < 492 THEN 'X7_city_coordinate_mismatch'
 WHEN m < 496 THEN 'P1_tiv_x1000'
 WHEN m < 516 THEN 'P2_round_tiv_repeated'
 WHEN row_id = 517 THEN 'P3_single_location_35pct_tiv'
 WHEN m = 516 THEN NULL
 WHEN m < 597 THEN 'P4_year_built_1900_cluster'
 WHEN m < 717 THEN 'P5_industrial_one_storey_default'
 WHEN m < 729 THEN 'G1_sea_coordinate'
 WHEN m < 735 THEN 'G2_lat_lon_swap'
 WHEN m < 737 THEN 'G3_zero_zero'
 WHEN m < 740 THEN 'G4_outside_india'
 WHEN m < 780 THEN 'G5_postcode_centroid_clustering'
 WHEN m < 830 THEN 'K1_free_text_construction'
 WHEN m < 860 THEN 'K2_unknown_occupancy'
 WHEN m < 880 THEN 'K3_mixed_construction_scheme'
 WHEN m < 890 THEN 'K4_currency_inconsistency'
 WHEN m < 898 THEN 'D2_shared_coordinates'
 WHEN m < 903 THEN 'D3_near_duplicate_address'
 WHEN m < 906 THEN 'D4_same_location_different_tiv'
END"""


def marked_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived portfolio with its error marker ``m``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(PORTFOLIO_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)


def pristine_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean row per order: what error injection starts from."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(PRISTINE_SQL.replace("FROM orders", "FROM {orders}"), orders=orders).drop("m")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_portfolio(spark, sf_dir).drop("m")


def clean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_portfolio(spark, sf_dir).filter("m BETWEEN 910 AND 999").drop("m")


def ground_truth_of(marked: DataFrame) -> DataFrame:
    """``(row_id, error_type, dimension)`` of every injected error."""
    names = {"C": "Completeness", "V": "Validity", "X": "Consistency", "D": "Duplication",
             "G": "Geography", "K": "Coding", "P": "Plausibility"}
    kind = F.substring("error_type", 1, 1)
    dimension = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in names.items()])
    return (
        marked.select("row_id", F.expr(ERROR_CASE).alias("error_type"))
        .filter("error_type IS NOT NULL")
        .withColumn("dimension", dimension)
    )


def postcodes(spark: SparkSession) -> DataFrame:
    rows = [(str(700000 + i * 1000 + j), d[0]) for i, d in enumerate(LAND) for j in range(10)]
    return spark.createDataFrame(rows, "postcode string, district string")


def _ring(poly_id: str, west: float, south: float, east: float, north: float) -> list[tuple]:
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return [(poly_id, *a, *b) for a, b in zip(corners, corners[1:])]


_EDGES = "poly_id string, x1 double, y1 double, x2 double, y2 double"


def land_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [e for d, w, s in LAND for e in _ring(d, w, s, w + 1, s + 1)], _EDGES)


def country_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ring("S", *COUNTRY), _EDGES)


def grid(spark: SparkSession) -> DataFrame:
    """Every multiple of 0.25 degrees around the districts, with TIV and AAL."""
    rows = []
    for i in range(339, 350):
        for j in range(75, 90):
            tiv = 1e9 * ((i + j) % 7)
            rows.append((i / 4, j / 4, tiv, 0.01 * tiv))
    return spark.createDataFrame(
        rows, "grid_lon double, grid_lat double, project1_tiv double, project1_aal double")


def fallback_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(d, s + 0.5, w + 0.5) for d, w, s in LAND],
        "district string, latitude double, longitude double")


def validated_tiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, tiv_total)`` of the trusted portfolio: the value before any corruption."""
    base = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    h1, h2, h3 = (k * 7919 + 13) % 10007, (k * 104729 + 7) % 10009, (k * 1299709 + 3) % 10037
    building = ((50 + h3 % 900) * (30000 + h2 % 20000)).cast("double")
    insured = h1 % 20
    interruption = F.when((insured >= 12) & (insured < 19), building * 0.2).otherwise(F.lit(0.0))
    return base.select(
        (k + 1).alias("row_id"), (building + building * 0.25 + interruption).alias("tiv_total"))
