"""Treatment: one grouped pass over the findings, one join to the portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ["latitude", "longitude", "construction", "occupancy", "currency", "tiv_total",
          "geocode_level"]
SOURCE_OF = {"construction": "construction_code", "occupancy": "occupancy_code"}
FIXES = ["G-002", "K-001", "K-003", "K-004", "V-001"]
RAW = ["location_id", "account_id", "address_line", "city", "district", "state", "postcode",
       "occupancy_code", "construction_code", "year_built", "num_storeys", "floor_area_sqm",
       "tiv_building", "tiv_contents", "tiv_bi", "tiv_total", "currency", "deductible",
       "policy_limit"]
AUDIT = ["treatment_applied", "treatment_rule", "treatment_method", "classification",
         "priority", "quarantined", "referred"]
# Spellings of the portfolio currency.
HOME_CURRENCY = ["INR", "₹", "RS", "RUPEES"]


def findings_with_priority(flags: DataFrame, scores: DataFrame | None) -> DataFrame:
    """``(row_id, rule_id, priority)``; the priority is NULL without a score."""
    pairs = flags.select("row_id", "rule_id")
    if scores is None:
        return pairs.withColumn("priority", F.lit(None).cast("string"))
    # by record: a partitioning on row_id is all that this needs
    by_record = scores.groupBy("row_id").agg(F.collect_list(F.struct("rule_id", "priority")).alias("__scores"))
    own = F.filter("__scores", lambda s: s.getField("rule_id") == F.col("rule_id"))
    return pairs.join(by_record, "row_id", "left").select(
        "row_id", "rule_id", F.get(own, F.lit(0)).getField("priority").alias("priority"))


def with_action(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add classification, action, method and catalogue order; unknown rules are dropped."""
    traits = catalogue.select("rule_id", "classification", "action", "method", "seq")
    return findings.join(F.broadcast(traits), "rule_id")


def _has(rule_id: str) -> str:
    return f"has_{rule_id.replace('-', '').lower()}"


def per_record(actions: DataFrame) -> DataFrame:
    """One row per record with findings: audit strings, outcome flags, fixes to apply.

    A record has at most one finding per rule, so no group exceeds the catalogue.
    """
    # one list per record, from which all strings are made: several lists would be kept, merged and sorted each
    said = F.struct("seq", F.concat_ws(": ", "rule_id", "method").alias("text"), "rule_id", "classification", "priority")

    def joined(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col("__said").getField(column))), ";")

    def any_of(action: str) -> Column:
        return F.bool_or(F.col("action") == action)

    outcomes = ["quarantined", "referred", "assumed", "fixed"]
    grouped = actions.groupBy("row_id").agg(
        F.collect_list(said).alias("__said"), *[any_of(o.upper()).alias(o) for o in outcomes],
        *[F.bool_or(F.col("rule_id") == r).alias(_has(r)) for r in FIXES],
    ).select(
        "row_id", joined("rule_id").alias("treatment_rule"),
        joined("classification").alias("classification"),
        F.nullif(joined("priority"), F.lit("")).alias("priority"),
        F.array_join(F.array_sort("__said").getField("text"), " | ").alias("treatment_method"),
        *outcomes, *[_has(r) for r in FIXES],
    )
    return grouped.withColumn(
        "treatment_applied",
        F.when(F.col("quarantined"), "QUARANTINED").when(F.col("referred"), "REFERRED")
        .when(F.col("assumed"), "ASSUMED").when(F.col("fixed"), "FIXED").otherwise("NONE"))


def canonical_construction(code: Column) -> Column:
    """Known materials by name; anything else is left as it is."""
    v = F.upper(F.trim(code))
    return (
        F.when(v.contains("RCC") | v.contains("REINFORCED CEMENT CONCRETE"), "RCC")
        .when(v.contains("MASON"), "MASONRY").when(v.contains("STEEL"), "STEEL")
        .when(v.contains("TIMBER"), "TIMBER").otherwise(code)
    )


def canonical_currency(code: Column) -> Column:
    v = F.upper(F.trim(code))
    return F.when(v.isin(HOME_CURRENCY), "INR").otherwise(v)


def apply(portfolio: DataFrame, records: DataFrame) -> DataFrame:
    """The cleansed portfolio: ``*_clean``, ``*_orig``, audit columns and raw columns.

    Numeric construction codes are flagged by K-001 and K-003; K-003 comes later
    in the catalogue, so its mapping of the original code wins.
    """
    treated = portfolio.join(records, "row_id", "left")
    orig = {f"{f}_orig": F.col(SOURCE_OF.get(f, f)) for f in FIELDS}

    def has(rule_id: str) -> Column:
        return F.coalesce(F.col(_has(rule_id)), F.lit(False))

    c = F.col
    clean = {
        "latitude_clean": F.when(has("G-002"), c("longitude")).otherwise(c("latitude")),
        "longitude_clean": F.when(has("G-002"), c("latitude")).otherwise(c("longitude")),
        "construction_clean": F.when(has("K-003"), canonical_construction(c("construction_code")))
        .when(has("K-001"), "RCC").otherwise(c("construction_code")),
        "occupancy_clean": c("occupancy_code"),
        "currency_clean": F.when(has("K-004"), canonical_currency(c("currency")))
        .otherwise(c("currency")),
        "tiv_total_clean": F.when(has("V-001"), F.abs("tiv_total")).otherwise(c("tiv_total")),
        "geocode_level_clean": c("geocode_level"),
    }
    audit = {
        "treatment_applied": F.coalesce("treatment_applied", F.lit("NONE")),
        "quarantined": F.coalesce("quarantined", F.lit(False)),
        "referred": F.coalesce("referred", F.lit(False)),
    }
    raw = [clean["tiv_total_clean"].alias(r) if r == "tiv_total" else c(r) for r in RAW]
    return treated.select(
        "row_id",
        *[v.alias(k) for k, v in clean.items()],
        *[v.alias(k) for k, v in orig.items()],
        *[audit[a].alias(a) if a in audit else c(a) for a in AUDIT],
        *raw,
    )


def treat(
    portfolio: DataFrame, flags: DataFrame, catalogue: DataFrame, scores: DataFrame | None = None
) -> DataFrame:
    findings = findings_with_priority(flags, scores)
    return apply(portfolio, per_record(with_action(findings, catalogue)))


def summary(cleansed: DataFrame, column: str = "treatment_applied") -> DataFrame:
    """Records per treatment (or classification); NULL reads ``NONE``."""
    value = F.coalesce(F.col(column), F.lit("NONE"))
    return cleansed.groupBy(value.alias(column)).agg(F.count("*").alias("count"))
