"""Table schemas and the rule catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

# --------------------------------------------------------------------- schemas

PORTFOLIO = T.StructType([
    T.StructField("row_id", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in (
        "location_id", "account_id", "address_line", "city", "district", "state", "postcode")],
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in (
        "geocode_level", "occupancy_code", "construction_code")],
    T.StructField("year_built", T.IntegerType()),
    T.StructField("num_storeys", T.IntegerType()),
    T.StructField("floor_area_sqm", T.DoubleType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "tiv_building", "tiv_contents", "tiv_bi", "tiv_total")],
    T.StructField("currency", T.StringType()),
    T.StructField("deductible", T.DoubleType()),
    T.StructField("policy_limit", T.DoubleType()),
])

GROUND_TRUTH = T.StructType([
    T.StructField("row_id", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in (
        "error_type", "dimension", "classification", "original_value", "corrupted_value")],
])

POSTCODES = T.StructType([
    T.StructField("postcode", T.StringType()),
    T.StructField("district", T.StringType()),
])

POINTS = T.StructType([
    T.StructField("grid_lon", T.DoubleType()),
    T.StructField("grid_lat", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

AAL_POINTS = T.StructType([*POINTS.fields, T.StructField("aal", T.DoubleType())])

FALLBACK_POINTS = T.StructType([
    T.StructField("district", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

FLAGS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("flagged_value", T.StringType()),
])

# ------------------------------------------------------------ rule catalogue
#
# Ids, severities, classifications, axes, actions, audit texts and
# error-type names are an interface and must read exactly like this.

DIMENSIONS = {
    "C": "Completeness", "V": "Validity", "X": "Consistency", "D": "Duplication",
    "G": "Geography", "K": "Coding", "P": "Plausibility",
}

ERROR_TYPES = {
    "C-001": "C1_missing_coordinates", "C-002": "C2_missing_construction",
    "C-003": "C3_missing_year_built", "C-004": "C4_missing_storeys",
    "C-005": "C5_missing_contents", "C-006": "C6_missing_deductible",
    "C-007": "C7_missing_occupancy",
    "V-001": "V1_negative_tiv", "V-002": "V2_zero_tiv", "V-003": "V3_invalid_latitude",
    "V-004": "V4_future_year", "V-005": "V5_implausibly_old_year",
    "V-006": "V6_invalid_storeys", "V-007": "V7_deductible_gt_tiv",
    "X-001": "X1_timber_25_storeys", "X-002": "X2_rcc_1880",
    "X-003": "X3_residential_high_tiv", "X-004": "X4_warehouse_25_storeys",
    "X-005": "X5_floor_area_storey_mismatch", "X-006": "X6_postcode_district_mismatch",
    "X-007": "X7_city_coordinate_mismatch",
    "D-001": "D1_exact_row_duplicate", "D-002": "D2_shared_coordinates",
    "D-003": "D3_near_duplicate_address", "D-004": "D4_same_location_different_tiv",
    "P-001": "P1_tiv_x1000", "P-002": "P2_round_tiv_repeated",
    "P-003": "P3_single_location_35pct_tiv", "P-004": "P4_year_built_1900_cluster",
    "P-005": "P5_industrial_one_storey_default",
    "G-001": "G1_sea_coordinate", "G-002": "G2_lat_lon_swap", "G-003": "G3_zero_zero",
    "G-004": "G4_outside_india", "G-005": "G5_postcode_centroid_clustering",
    "K-001": "K1_free_text_construction", "K-002": "K2_unknown_occupancy",
    "K-003": "K3_mixed_construction_scheme", "K-004": "K4_currency_inconsistency",
}

HIGH = {
    "C-001", "C-007", "V-001", "V-003", "V-004", "V-006", "V-007", "X-001", "X-003", "X-006",
    "X-007", "D-001", "D-004", "P-001", "P-003", "G-001", "G-002", "G-003", "G-004",
    "K-002", "K-003", "K-004",
}
LOW = {"C-006"}

UNKNOWN = {
    "V-002", "V-005", "X-001", "X-002", "X-003", "X-004", "X-005", "D-002", "D-003",
    "P-002", "P-003", "P-004", "P-005",
}
ASSUMPTION = {"G-005"}

HAZARD = {"C-001", "V-003", "X-006", "X-007", "G-001", "G-002", "G-003", "G-004", "G-005"}
VULNERABILITY = {
    "C-002", "C-003", "C-004", "C-007", "V-004", "V-005", "V-006", "X-001", "X-002", "X-004",
    "P-004", "P-005", "K-001", "K-002", "K-003",
}
FINANCIAL = {
    "C-005", "C-006", "V-001", "V-002", "V-007", "X-003", "X-005", "D-001", "D-002", "D-003",
    "D-004", "P-001", "P-002", "P-003", "K-004",
}

FIX_METHODS = {
    "V-001": "Converted negative total TIV to absolute value",
    "G-002": "Swapped latitude and longitude back to original coordinate order",
    "K-001": "Mapped free-text construction variant to canonical RCC code",
    "K-003": "Mapped mixed construction coding to canonical construction code",
    "K-004": "Normalised currency to canonical code",
}
QUARANTINE_METHODS = {
    "V-003": "Invalid latitude excluded from modelling",
    "D-001": "Finding could not be safely resolved",
    "D-004": "Conflicting TIV for same location ID excluded pending reconciliation",
    "G-003": "Invalid zero/zero coordinates excluded from modelling",
    "G-004": "Coordinates outside India excluded from modelling",
}
ASSUMPTION_METHODS = {
    "P-004": "Repeated 1900 construction year retained as documented assumption",
    "P-005": "Industrial one-storey pattern retained as documented assumption",
    "G-005": "Postcode-level geocoding assumption retained and documented",
}
REFERRAL_METHODS = {
    "C-001": "Missing coordinates require broker/source confirmation",
    "C-002": "Missing construction requires broker/source confirmation",
    "C-003": "Missing year built requires broker/source confirmation",
    "C-004": "Missing storeys requires broker/source confirmation",
    "C-005": "Missing contents TIV requires broker/source confirmation",
    "C-006": "Missing deductible requires broker/source confirmation",
    "C-007": "Missing occupancy requires broker/source confirmation",
    "V-002": "Zero TIV requires source confirmation",
    "V-004": "Future year built requires source confirmation",
    "V-005": "Implausibly old year built requires source confirmation",
    "V-006": "Invalid storeys requires source confirmation",
    "V-007": "Deductible exceeding TIV requires policy/source confirmation",
    "X-001": "Timber/high-storey inconsistency requires source confirmation",
    "X-002": "RCC/1880 inconsistency requires source confirmation",
    "X-003": "Residential/high-TIV inconsistency requires source confirmation",
    "X-004": "Warehouse/storey inconsistency requires source confirmation",
    "X-005": "Floor-area/value inconsistency requires source confirmation",
    "X-006": "Postcode/district mismatch requires geographic reconciliation",
    "X-007": "City/coordinate mismatch requires geographic reconciliation",
    "D-002": "Shared coordinates require source reconciliation",
    "D-003": "Near-duplicate address requires source reconciliation",
    "P-001": "TIV anomaly requires financial/source confirmation",
    "P-002": "Repeated rounded TIV requires source confirmation",
    "P-003": "Concentrated TIV requires source confirmation",
    "K-002": "Unknown occupancy requires source confirmation",
}
REFERRAL_DEFAULT = "Finding referred for source confirmation"

DIMENSION_ORDER = [
    "Completeness", "Validity", "Consistency", "Duplication", "Geography", "Coding",
    "Plausibility",
]

# City expected in each district (lower case), used when the caller passes no map.
DISTRICT_CITIES = {
    "khordha": "bhubaneswar", "cuttack": "cuttack", "puri": "puri",
    "jagatsinghpur": "paradip",
}
# End of fixed values.

DESCRIPTIONS = {
    "C-001": "A coordinate is absent.",
    "C-002": "The construction code is absent.",
    "C-003": "The year of construction is absent.",
    "C-004": "The number of storeys is absent.",
    "C-005": "The contents value is absent.",
    "C-006": "The deductible is absent.",
    "C-007": "The occupancy code is absent.",
    "V-001": "The total value is below zero.",
    "V-002": "The building value is zero.",
    "V-003": "A coordinate lies outside the degree range.",
    "V-004": "The year of construction lies in the future.",
    "V-005": "The year of construction is before 1850.",
    "V-006": "The number of storeys is not positive.",
    "V-007": "The deductible is larger than the total value.",
    "X-001": "A timber building has more than four storeys.",
    "X-002": "A reinforced-concrete building is dated before 1900.",
    "X-003": "A home has a building value of 800 million or more.",
    "X-004": "An industrial building has more than twenty storeys.",
    "X-005": "Building value per square metre is above the calibrated limit.",
    "X-006": "The postcode belongs to another district.",
    "X-007": "The city does not belong to the stated district.",
    "D-001": "An earlier record has the same content.",
    "D-002": "Another location id sits on the same coordinates.",
    "D-003": "The address looks like a variant of another one.",
    "D-004": "The location id occurs with another building value.",
    "P-001": "Building value is above the calibrated limit.",
    "P-002": "A round total value occurs at least ten times.",
    "P-003": "One record holds a tenth of the portfolio or more.",
    "P-004": "The year 1900 occurs a hundred times or more.",
    "P-005": "At least half of the industrial records have one storey.",
    "G-001": "The point lies in none of the land polygons.",
    "G-002": "The point lies on land once its coordinates are swapped.",
    "G-003": "Both coordinates are zero.",
    "G-004": "The point lies outside the country.",
    "G-005": "At least ten postcode-level records share one point.",
    "K-001": "The construction code is free text.",
    "K-002": "The occupancy code is not in the scheme.",
    "K-003": "The construction code belongs to a numeric scheme.",
    "K-004": "The currency is not the portfolio currency.",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    dimension: str
    description: str
    severity: str
    classification: str
    rationale: str
    affects_hazard: bool
    affects_vulnerability: bool
    affects_financial: bool
    tested_by_injection: bool
    injection_rule: str
    error_type: str
    action: str
    method: str
    seq: int


def _rule(seq: int, rule_id: str) -> Rule:
    if rule_id in FIX_METHODS:
        action, method = "FIXED", FIX_METHODS[rule_id]
    elif rule_id in QUARANTINE_METHODS:
        action, method = "QUARANTINED", QUARANTINE_METHODS[rule_id]
    elif rule_id in ASSUMPTION_METHODS:
        action, method = "ASSUMED", ASSUMPTION_METHODS[rule_id]
    else:
        action, method = "REFERRED", REFERRAL_METHODS.get(rule_id, REFERRAL_DEFAULT)
    axes = [n for n, ids in (("hazard", HAZARD), ("vulnerability", VULNERABILITY),
                             ("financial", FINANCIAL)) if rule_id in ids]
    return Rule(
        rule_id=rule_id,
        dimension=DIMENSIONS[rule_id[0]],
        description=DESCRIPTIONS[rule_id],
        severity="HIGH" if rule_id in HIGH else "LOW" if rule_id in LOW else "MEDIUM",
        classification="UNKNOWN" if rule_id in UNKNOWN
        else "ASSUMPTION" if rule_id in ASSUMPTION else "ERROR",
        rationale=f"Can change the {' and '.join(axes)} side of a loss estimate.",
        affects_hazard=rule_id in HAZARD,
        affects_vulnerability=rule_id in VULNERABILITY,
        affects_financial=rule_id in FINANCIAL,
        tested_by_injection=True,
        injection_rule=f"{rule_id[0]}{int(rule_id[2:])}",
        error_type=ERROR_TYPES[rule_id],
        action=action,
        method=method,
        seq=seq,
    )


RULES: list[Rule] = [_rule(i, r) for i, r in enumerate(ERROR_TYPES, start=1)]

_CATALOGUE = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "rule_id", "dimension", "description", "severity", "classification", "rationale")],
    *[T.StructField(c, T.BooleanType()) for c in (
        "affects_hazard", "affects_vulnerability", "affects_financial", "tested_by_injection")],
    *[T.StructField(c, T.StringType()) for c in (
        "injection_rule", "error_type", "action", "method")],
    T.StructField("seq", T.LongType()),
])


def catalogue(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule catalogue as a DataFrame: one row per rule, in execution order."""
    rows = [tuple(getattr(r, f.name) for f in _CATALOGUE.fields) for r in rules or RULES]
    return spark.createDataFrame(rows, _CATALOGUE)
