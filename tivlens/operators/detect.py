"""Detection: every finding of the catalogue as ``(row_id, rule_id, flagged_value)``.

A few scans answer all rules that need the row itself, a frozen threshold, a
portfolio total or a lookup of its postcode or place. The five rules about other
rows of the same group share one grouping pass, whose qualifying groups are stored,
and one pass that joins them back.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tivlens.functions.columns import fixed, money, norm, text
from tivlens.model import DISTRICT_CITIES
from tivlens.operators import rules
from tivlens.operators.groups import HOT_ROWS, join_stored
from tivlens.operators.sizing import lookup_join
from tivlens.operators.spatial import PolygonIndex, polygons_at
from tivlens.sources.tables import materialise


@dataclass(frozen=True)
class Threshold:
    """One calibrated reference row."""

    median: float
    multiplier: int
    threshold: float
    clean_max: float = float("nan")


@dataclass(frozen=True)
class References:
    """Everything detection compares the portfolio with. Absent entries skip their rules."""

    density: Threshold | None = None
    building_tiv: Threshold | None = None
    postcodes: DataFrame | None = None
    district_cities: dict[str, str] = field(default_factory=lambda: dict(DISTRICT_CITIES))
    land: PolygonIndex | None = None
    country: PolygonIndex | None = None
    as_of_year: int | None = None


#: Rules per generated method; more would exceed what the JVM compiles.
RULES_PER_SCAN = 12


def _explode_flags(rows: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per (row, rule) that holds.

    Rules that do not hold leave a NULL in a fixed-length array, so the whole
    step is generated code; the evidence text is built only where a rule holds.
    A long list of rules is split over several scans of fewer columns each.
    """
    items = list(checks.items())
    parts = []
    for start in range(0, len(items), RULES_PER_SCAN):
        flags = F.array(*[
            F.when(p, F.struct(F.lit(r).alias("rule_id"), v.alias("flagged_value")))
            for r, (p, v) in items[start:start + RULES_PER_SCAN]
        ])
        parts.append(rows.select("row_id", F.explode(flags).alias("f")).filter("f IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).select("row_id", "f.rule_id", "f.flagged_value")


def portfolio_totals(portfolio: DataFrame) -> rules.Totals:
    """The four numbers behind P-003, P-004 and P-005, in one pass."""
    industrial = norm("occupancy_code") == "ind"
    row = portfolio.agg(
        F.sum(F.when(F.col("tiv_total") > 0, money("tiv_total"))).cast("double"),
        F.count_if(F.col("year_built") == 1900),
        F.count_if(industrial),
        F.count_if(industrial & (F.col("num_storeys") == 1)),
    ).first()
    return rules.Totals(*row)


def row_checks(portfolio: DataFrame, refs: References, only: set[str] | None = None
               ) -> dict[str, tuple[Column, Column]]:
    """The rules that need one row, a frozen threshold or a portfolio total."""
    checks = dict(rules.local_rules(refs.as_of_year))
    if refs.density:
        checks["X-005"] = rules.density_rule(refs.density.threshold)
    checks["X-007"] = rules.city_rule(refs.district_cities)
    if refs.building_tiv:
        t = refs.building_tiv
        checks["P-001"] = rules.extreme_rule(t.median, t.multiplier, t.threshold)
    if only is None or TOTAL_RULES & only:
        checks |= rules.portfolio_rules(portfolio_totals(portfolio))
    if "malformed" in portfolio.columns:  # of a scan that keeps them: something was there, so it isn't missing
        checks = {r: (p & ~_malformed(rules.COMPLETENESS[r]) if r in rules.COMPLETENESS else p, v)
                  for r, (p, v) in checks.items()}
    if only is not None:
        checks = {r: pv for r, pv in checks.items() if r in only}
    return checks


def _malformed(fields: list[str]) -> Column:
    return F.coalesce(F.exists("malformed", lambda m: m.getField("field").isin(fields)), F.lit(False))


def row_flags(portfolio: DataFrame, refs: References, only: set[str] | None = None) -> DataFrame:
    """Findings of the rules that need one row, a frozen threshold or a portfolio total."""
    return _explode_flags(portfolio, row_checks(portfolio, refs, only))


def _with_land(rows: DataFrame, refs: References, only: set[str] | None
               ) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """G-001, G-002 and G-004: the rows with one lookup per polygon test, and the rules."""
    checks = {r: pv for r, pv in rules.land_rules().items() if only is None or r in only}
    if "G-001" in checks:
        rows = polygons_at(rows, refs.land, "longitude", "latitude", "land")
    if "G-002" in checks:
        rows = polygons_at(rows, refs.land, "latitude", "longitude", "land_swapped")
    if "G-004" in checks:
        rows = polygons_at(rows, refs.country, "longitude", "latitude", "country")
    return rows, checks


def _with_postcode_districts(rows: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Add the districts listed for the trimmed postcode."""
    listed = postcodes.groupBy(F.trim("postcode").alias("__postcode")).agg(
        F.array_sort(F.collect_set("district")).alias("__listed"))
    return lookup_join(rows.withColumn("__postcode", F.trim("postcode")), listed, ["__postcode"])


def _postcode_rule() -> tuple[Column, Column]:
    """X-006: a district listed for the postcode differs from the stated one."""
    other = F.filter("__listed", lambda d: d != F.col("district"))
    return F.size(other) > 0, text(
        "postcode=", F.col("postcode"), ", district=", F.col("district"),
        ", reference_district=", F.array_join(other, "/"))


# ------------------------------------------------------------------ group rules

#: Content compared by D-001, by type; NULL equals the sentinel. The geocode level is not compared.
SAME_IDS = ["location_id", "account_id"]
SAME_TEXT = ["address_line", "city", "district", "state", "postcode",
             "occupancy_code", "construction_code", "currency"]
SAME_NUMBERS = ["latitude", "longitude", "year_built", "num_storeys", "floor_area_sqm",
                "tiv_building", "tiv_contents", "tiv_bi", "tiv_total", "deductible",
                "policy_limit"]

#: What a group has in common, as a number in the key, and the rules that look at it.
CONTENT, POINT, LOCATION, ROUNDED = range(4)
KIND_RULES = {CONTENT: {"D-001"}, POINT: {"D-002", "G-005"}, LOCATION: {"D-004"}, ROUNDED: {"P-002"}}
GROUP_KEY = ["kind", "h", "s", "x", "y"]


def _content() -> list[Column]:
    return [
        *[F.col(c) for c in SAME_IDS],
        *[F.coalesce(F.col(c), F.lit("")) for c in SAME_TEXT],
        # + 0.0 so that the hash sees one zero
        *[F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) + F.lit(0.0) for c in SAME_NUMBERS],
    ]


def _at_postcode() -> Column:
    return F.coalesce(norm("geocode_level") == "postcode", F.lit(False))


def _near_million(value: Column) -> Column:
    return F.abs(value - F.round(value / F.lit(1000000.0), 0) * F.lit(1000000.0))


def _keys(kinds: set[int]) -> dict[int, tuple[Column, Column]]:
    """Per kind: whether a row belongs to a group, and the group's key (unused parts are empty)."""
    def key(kind: int, h=None, s=None, x=None, y=None) -> Column:
        parts = (F.lit(0) if h is None else h).cast("long"), F.lit("") if s is None else s, \
            F.lit(0.0) if x is None else x, F.lit(0.0) if y is None else y
        return F.struct(F.lit(kind).alias("kind"), *[p.alias(n) for p, n in zip(parts, GROUP_KEY[1:], strict=True)])

    c, zero = F.col, F.lit(0.0)
    rounded = F.round(money("tiv_total"), 0)
    every = {
        # a hash finds the few rows that may have a copy; their columns decide
        CONTENT: (c("location_id").isNotNull() & c("account_id").isNotNull(), key(CONTENT, h=F.xxhash64(*_content()))),
        POINT: (c("latitude").isNotNull() & c("longitude").isNotNull(),
                key(POINT, x=c("latitude") + zero, y=c("longitude") + zero)),
        LOCATION: (c("location_id").isNotNull(), key(LOCATION, s=c("location_id"))),
        # a value within 1 of a multiple rounds to within 1 of it, which spares other groups
        ROUNDED: (_near_million(rounded.cast("double")) <= 1.0, key(ROUNDED, s=rounded.cast("string"))),
    }
    return {k: v for k, v in every.items() if k in kinds}


def shared_groups(portfolio: DataFrame, kinds: set[int], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The groups that rules about several rows ask for, of all kinds in one pass, stored.

    Every row names its groups, one grouping counts them (hot ones are combined before the
    shuffle) and only those that qualify are kept: ``kind, h, s, x, y, n, several, postcodes, hot``.
    """
    def of(kind: int, value: Column) -> Column:
        return F.when(F.col("g.kind") == kind, value)

    named = F.col("location_id").isNotNull()
    keys = [F.when(present, key) for present, key in _keys(kinds).values()]
    rows = portfolio.select(
        F.explode(F.array(*keys)).alias("g"), F.col("tiv_building").alias("v"),
        # two hashes: 128 bits tell locations apart without comparing text
        F.when(named, F.xxhash64("location_id")).alias("l1"),
        F.when(named, F.xxhash64(F.lit("l"), "location_id")).alias("l2"),
        _at_postcode().cast("int").alias("p")).filter("g IS NOT NULL")
    counted = rows.groupBy(*[F.col(f"g.{k}").alias(k) for k in GROUP_KEY]).agg(
        F.count("*").alias("n"), F.sum(of(POINT, F.col("p"))).alias("postcodes"),
        *[f(of(POINT, F.col(h))).alias(f"{name}_{h}") for h in ("l1", "l2") for f, name in ((F.min, "low"), (F.max, "high"))],
        F.count(of(LOCATION, F.col("v"))).alias("known"),
        F.min(of(LOCATION, F.col("v"))).alias("low"), F.max(of(LOCATION, F.col("v"))).alias("high"))
    several = F.coalesce(F.expr("low_l1 <> high_l1 OR low_l2 <> high_l2"), F.lit(False))
    qualifies = (
        F.when(F.col("kind") == CONTENT, F.col("n") > 1)
        .when(F.col("kind") == POINT, F.col("several") | (F.col("postcodes") >= 10))
        .when(F.col("kind") == LOCATION, F.expr("low <> high OR (known > 0 AND known < n)"))
        .otherwise(F.col("n") >= 10))
    return materialise(counted.withColumn("several", several).filter(qualifies).select(
        *GROUP_KEY, "n", "several", F.coalesce("postcodes", F.lit(0)).alias("postcodes"),
        (F.col("n") > hot_rows).alias("hot")), "groups")


def _member_rules() -> dict[str, tuple[Column, Column]]:
    """The rules over rows joined with a qualifying group; D-001 only finds candidates here."""
    c = F.col
    t = c("tiv_total").cast("double")
    point = c("kind") == POINT
    return {
        "D-002": (point & c("several") & c("location_id").isNotNull(),
                  text("location_id=", c("location_id"), ", shared coordinates with another location")),
        "G-005": (point & _at_postcode() & (c("postcodes") >= 10),
                  text(rules.point_evidence(), ", geocode_level=", c("geocode_level"),
                       ", coordinate_cluster_count=", c("postcodes").cast("string"))),
        "D-004": (c("kind") == LOCATION,
                  text("location_id=", c("location_id"),
                       ", tiv_building=", fixed("tiv_building", rules.MONEY_SCALE), ", conflicting TIV")),
        "P-002": ((c("kind") == ROUNDED) & (t > 0) & (_near_million(t) < 1.0),
                  text("tiv_total=", fixed("tiv_total", rules.MONEY_SCALE), ", rounded_value=", c("s"),
                       ", occurrences=", c("n").cast("string"))),
    }


def group_flags(
    portfolio: DataFrame, only: set[str] | None = None, *, max_rows: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """D-001, D-002, D-004, G-005 and P-002: two passes over the portfolio for all of them.

    The first stores the qualifying groups, the second joins them back. For D-001 the second
    pass stores the candidates' columns, and all but the first row of each content are copies.
    """
    wanted = GROUP_RULES if only is None else GROUP_RULES & only
    kinds = {k for k, own in KIND_RULES.items() if own & wanted}
    groups = shared_groups(portfolio, kinds, hot_rows)
    parts = []
    if kinds - {CONTENT}:
        keys = [F.when(present, key) for present, key in _keys(kinds - {CONTENT}).values()]
        rows = portfolio.select(
            "row_id", "location_id", "geocode_level", "latitude", "longitude", "tiv_building", "tiv_total",
            F.explode(F.array(*keys)).alias("g")).filter("g IS NOT NULL").select("*", "g.*").drop("g")
        members = join_stored(rows, groups.filter(F.col("kind") != CONTENT), GROUP_KEY, max_rows)
        parts.append(_explode_flags(members, {r: pv for r, pv in _member_rules().items() if r in wanted}))
    if CONTENT in kinds:
        parts.append(_copies(portfolio, groups.filter(F.col("kind") == CONTENT), max_rows))
    return reduce(DataFrame.unionByName, parts)


def _copies(portfolio: DataFrame, groups: DataFrame, max_rows: int | None) -> DataFrame:
    """D-001: a record with the same content has a smaller row id."""
    present, key = _keys({CONTENT})[CONTENT]
    rows = portfolio.filter(present).select(
        "row_id", F.struct(*_content()).alias("content"), key.getField("h").alias("h"))
    candidates = materialise(
        join_stored(rows, groups.select("h", "hot"), ["h"], max_rows).select("row_id", "content"), "candidates")
    first = candidates.groupBy("content").agg(F.min("row_id").alias("row_id")).select("row_id")
    return candidates.join(first, "row_id", "left_anti").select(
        "row_id", F.lit("D-001").alias("rule_id"),
        F.lit("Exact duplicate of another portfolio record").alias("flagged_value"))


TOTAL_RULES = {"P-003", "P-004", "P-005"}
LAND_RULES = {"G-001", "G-002", "G-004"}
GROUP_RULES = {"D-001", "D-002", "D-004", "P-002", "G-005"}


def detect(portfolio: DataFrame, refs: References, only: set[str] | None = None) -> DataFrame:
    """All findings, or those of the rules in ``only``. One row per (row_id, rule_id).

    The row rules share scans, each of which reads only its own columns; the lookups of postcodes
    and polygons ride along with the last of them.
    """

    def wanted(*ids: str) -> bool:
        return only is None or bool(only.intersection(ids))

    items = []
    if only is None or only - GROUP_RULES - LAND_RULES - {"X-006"}:
        items = list(row_checks(portfolio, refs, only).items())
    scans = [dict(items[i:i + RULES_PER_SCAN]) for i in range(0, len(items), RULES_PER_SCAN)] or [{}]
    last = portfolio
    if refs.postcodes is not None and wanted("X-006"):
        last = _with_postcode_districts(last, refs.postcodes)
        scans[-1]["X-006"] = _postcode_rule()
    if refs.land and refs.country and wanted(*LAND_RULES):
        last, checks = _with_land(last, refs, only)
        scans[-1] |= checks
    parts = [_explode_flags(portfolio, checks) for checks in scans[:-1]]
    if scans[-1]:
        parts.append(_explode_flags(last, scans[-1]))
    if wanted(*GROUP_RULES):
        parts.append(group_flags(portfolio, only))
    return reduce(DataFrame.unionByName, parts)
