"""Row-level rules: predicate and evidence of every rule that needs no grouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tivlens.functions.columns import blank, fixed, norm, text
from tivlens.operators.spatial import is_inside

MONEY_SCALE = 4
AREA_SCALE = 6
DEGREE_SCALE = 8


#: The typed fields whose absence each completeness rule reports.
COMPLETENESS = {
    "C-001": ["latitude", "longitude"], "C-003": ["year_built"], "C-004": ["num_storeys"],
    "C-005": ["tiv_contents"], "C-006": ["deductible"],
}


def _int(name: str) -> Column:
    return F.col(name).cast("string")


def _money(name: str) -> Column:
    return fixed(name, MONEY_SCALE)


def point_evidence() -> Column:
    return text("latitude=", fixed("latitude", DEGREE_SCALE),
                ", longitude=", fixed("longitude", DEGREE_SCALE))


def local_rules(as_of_year: int | None = None) -> dict[str, tuple[Column, Column]]:
    """Rules that look at one row only: ``rule_id -> (predicate, evidence)``."""
    construction, occupancy = norm("construction_code"), norm("occupancy_code")
    c = F.col
    this_year = F.lit(as_of_year) if as_of_year is not None else F.year(F.current_date())
    return {
        "C-001": (c("latitude").isNull() | c("longitude").isNull(), point_evidence()),
        "C-002": (blank("construction_code"), F.lit("construction_code=NULL")),
        "C-003": (c("year_built").isNull(), F.lit("year_built=NULL")),
        "C-004": (c("num_storeys").isNull(), F.lit("num_storeys=NULL")),
        "C-005": (c("tiv_contents").isNull(), F.lit("tiv_contents=NULL")),
        "C-006": (c("deductible").isNull(), F.lit("deductible=NULL")),
        "C-007": (blank("occupancy_code"), F.lit("occupancy_code=NULL")),
        "V-001": (c("tiv_total") < 0, _money("tiv_total")),
        "V-002": (c("tiv_building") == 0, _money("tiv_building")),
        "V-003": (
            ~F.coalesce(c("latitude").between(-90, 90), F.lit(True))
            | ~F.coalesce(c("longitude").between(-180, 180), F.lit(True)),
            point_evidence(),
        ),
        "V-004": (c("year_built") > this_year, _int("year_built")),
        "V-005": (c("year_built") < 1850, _int("year_built")),
        "V-006": (c("num_storeys") <= 0, _int("num_storeys")),
        "V-007": (
            c("deductible") > c("tiv_total"),
            text("deductible=", _money("deductible"), ", tiv_total=", _money("tiv_total")),
        ),
        "X-001": (
            (construction == "timber") & (c("num_storeys") > 4),
            text("construction=", c("construction_code"), ", storeys=", _int("num_storeys")),
        ),
        "X-002": (
            (construction == "rcc") & (c("year_built") < 1900),
            text("construction=", c("construction_code"), ", year=", _int("year_built")),
        ),
        "X-003": (
            occupancy.isin("res", "residential") & (c("tiv_building") >= 800000000),
            text("occupancy=", c("occupancy_code"), ", tiv_building=", _money("tiv_building")),
        ),
        "X-004": (
            (occupancy == "ind") & (c("num_storeys") > 20),
            text("occupancy=", c("occupancy_code"), ", storeys=", _int("num_storeys")),
        ),
        "D-003": (
            norm("address_line").like("% ltd."),
            text("address=", c("address_line"), ", near-duplicate address candidate"),
        ),
        "G-003": ((c("latitude") == 0) & (c("longitude") == 0), point_evidence()),
        "K-001": (
            ~blank("construction_code")
            & ~construction.isin("rcc", "masonry", "steel", "timber"),
            text("construction_code=", c("construction_code")),
        ),
        "K-002": (
            ~blank("occupancy_code") & ~occupancy.isin("res", "com", "ind", "pub"),
            text("occupancy_code=", c("occupancy_code")),
        ),
        "K-003": (
            F.trim("construction_code").isin("01", "02", "03", "04"),
            text("construction_code=", c("construction_code")),
        ),
        "K-004": (
            c("currency").isNotNull() & (F.trim("currency") != "INR"),
            text("currency=", c("currency")),
        ),
    }


def density_rule(threshold: float) -> tuple[Column, Column]:
    """X-005: building value per square metre above the frozen threshold."""
    per_sqm = F.try_divide("tiv_building", "floor_area_sqm")
    return (
        (F.col("floor_area_sqm") > 0) & (per_sqm > F.lit(float(threshold))),
        text("floor_area=", fixed("floor_area_sqm", AREA_SCALE),
             ", tiv_building=", _money("tiv_building"),
             ", tiv_per_sqm=", fixed(per_sqm, 2),
             ", threshold_per_sqm=", fixed(F.lit(float(threshold)), 2)),
    )


def extreme_rule(median: float, multiplier: int, threshold: float) -> tuple[Column, Column]:
    """P-001: building value above the frozen threshold."""
    return (
        F.col("tiv_building") > F.lit(float(threshold)),
        text("tiv_building=", _money("tiv_building"),
             ", clean_baseline_median=", fixed(F.lit(float(median)), MONEY_SCALE),
             f", multiplier={int(multiplier)}",
             ", threshold_tiv_building=", fixed(F.lit(float(threshold)), MONEY_SCALE)),
    )


def city_rule(district_cities: dict[str, str]) -> tuple[Column, Column]:
    """X-007: the city is not the one expected in the district."""
    wrong = F.lit(False)
    for district, city in district_cities.items():
        wrong = wrong | ((norm("district") == district) & (norm("city") != city))
    return wrong, text("city=", F.col("city"), ", district=", F.col("district"))


@dataclass(frozen=True)
class Totals:
    """Portfolio-wide figures that rules compare a record with."""

    positive_tiv: float | None
    built_1900: int
    industrial: int
    one_storey: int


def portfolio_rules(totals: Totals) -> dict[str, tuple[Column, Column]]:
    """P-003, P-004, P-005: rules against portfolio totals."""
    c = F.col
    part = F.try_divide("tiv_total", F.lit(totals.positive_tiv).cast("double"))
    single = totals.one_storey / totals.industrial if totals.industrial else 0.0
    industrial_single = (norm("occupancy_code") == "ind") & (c("num_storeys") == 1)
    return {
        "P-003": (
            (c("tiv_total") > 0) & (part >= 0.10),
            text("tiv_building=", _money("tiv_building"),
                 ", portfolio_share=", fixed(part * 100, 2), "%"),
        ),
        "P-004": (
            (c("year_built") == 1900) & F.lit(totals.built_1900 >= 100),
            text("year_built=", _int("year_built"), f", occurrences={totals.built_1900}"),
        ),
        "P-005": (
            industrial_single & F.lit(single >= 0.50),
            text("occupancy=", c("occupancy_code"), ", storeys=", _int("num_storeys"),
                 ", industrial_one_storey_share=", fixed(F.lit(single * 100), 2), "%"),
        ),
    }


def land_rules() -> dict[str, tuple[Column, Column]]:
    """G-001, G-002, G-004 over the ``land``, ``land_swapped`` and ``country`` columns."""
    c = F.col
    present = c("latitude").isNotNull() & c("longitude").isNotNull()
    return {
        "G-001": (present & ~is_inside("land"), point_evidence()),
        "G-002": (
            (F.abs("latitude") <= 90) & (F.abs("longitude") <= 90)
            & (c("latitude") != c("longitude")) & is_inside("land_swapped"),
            point_evidence(),
        ),
        "G-004": (
            c("latitude").between(-90, 90) & c("longitude").between(-180, 180)
            & ~is_inside("country"),
            point_evidence(),
        ),
    }
