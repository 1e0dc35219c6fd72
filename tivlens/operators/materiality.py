"""Materiality: value percentile, spatial concentration, decision flag, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tivlens.functions.columns import cell, in_range, money_sum
from tivlens.operators.groups import join_groups
from tivlens.operators.ordering import rows_before, value_counts
from tivlens.operators.sizing import lookup_join
from tivlens.sources.tables import materialise

CELL = 0.25
MIN_FLAGS = 5
MIN_ENRICHMENT = 2
TOP = 90
UPPER = 50


def materiality_tiv(portfolio: DataFrame, reference: DataFrame) -> DataFrame:
    """``(row_id, materiality_tiv)``: the validated value, else the stated one."""
    return portfolio.select("row_id", "tiv_total").join(
        reference.select("row_id", "validated_tiv"), "row_id", "left"
    ).select("row_id", F.coalesce("validated_tiv", "tiv_total").alias("materiality_tiv"))


def percentiles(tiv: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add ``tiv_percentile`` = 100 x percent_rank in ascending order, rounded to 2.

    Rows without a value sort last: they count in the denominator and have no
    percentile. Ties share the lowest rank. The rank is found once per distinct
    value and joined back, so no window spans the portfolio.
    """
    counted = rows_before(value_counts(tiv, "materiality_tiv"), "materiality_tiv", "n", buckets)
    rows = tiv.agg(F.count("*").alias("n")).scalar()
    rank = F.coalesce(F.try_divide(F.col("before").cast("double"), (rows - 1).cast("double")), F.lit(0.0))
    # read three times below: keep the ranks instead of sorting again
    ranked = materialise(counted.select(
        "materiality_tiv", "n", F.round(rank * 100, 2).alias("tiv_percentile")), "ranks")
    known = join_groups(
        tiv.filter(F.col("materiality_tiv").isNotNull()), ranked, ["materiality_tiv"], "n"
    ).select("row_id", "materiality_tiv", "tiv_percentile")
    unknown = tiv.filter(F.col("materiality_tiv").isNull()).select(
        "row_id", "materiality_tiv", F.lit(None).cast("double").alias("tiv_percentile"))
    return known.unionByName(unknown)


def portfolio_cells(portfolio: DataFrame, size: float = CELL) -> DataFrame:
    """``(row_id, cell_x, cell_y)`` of the rows with valid coordinates."""
    return portfolio.filter(in_range("latitude", "longitude")).select(
        "row_id", cell("longitude", size).alias("cell_x"), cell("latitude", size).alias("cell_y"))


def cell_baseline(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_x", "cell_y").agg(F.count("*").alias("portfolio_count"))


def enriched_findings(
    flags: DataFrame, portfolio: DataFrame, reference: DataFrame, catalogue: DataFrame,
    percentile: DataFrame | None = None, size: float = CELL,
) -> DataFrame:
    """Distinct findings with value, percentile, cell and catalogue columns."""
    if percentile is None:
        percentile = percentiles(materiality_tiv(portfolio, reference))
    traits = F.broadcast(catalogue.select(
        "rule_id", "severity", "classification",
        "affects_hazard", "affects_vulnerability", "affects_financial"))
    located = in_range("latitude", "longitude")
    places = portfolio.select(
        "row_id",
        F.when(located, cell("longitude", size)).alias("cell_x"),
        F.when(located, cell("latitude", size)).alias("cell_y"),
    )
    # one row per record, so that one partitioning on row_id serves the grouping and both joins
    records = flags.groupBy("row_id").agg(F.collect_set("rule_id").alias("rules"))
    return (
        records.join(places, "row_id")
        .join(percentile, "row_id", "left")
        .withColumn("rule_id", F.explode("rules"))
        .join(traits, "rule_id")
        .select("row_id", "rule_id", "materiality_tiv", "tiv_percentile", "cell_x", "cell_y",
                "severity", "classification",
                "affects_hazard", "affects_vulnerability", "affects_financial")
    )


def rule_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("total_flags"))


def rule_cells(findings: DataFrame) -> DataFrame:
    return findings.filter("cell_x IS NOT NULL AND cell_y IS NOT NULL").groupBy(
        "rule_id", "cell_x", "cell_y").agg(F.count("*").alias("flagged_count"))


def concentration(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """Enrichment of each rule in each cell and whether it counts as concentrated.

    The comparison with the limit is done on whole numbers, so a ratio of exactly
    the limit is never lost to rounding.
    """
    baseline = cell_baseline(cells)
    located = cells.agg(F.count("*").alias("n")).scalar()
    wide = "decimal(19,0)"
    joined = (
        rule_cells(findings)
        .join(F.broadcast(rule_totals(findings)), "rule_id")  # one row per rule
        .join(baseline, ["cell_x", "cell_y"])
    )
    f, t, p = F.col("flagged_count"), F.col("total_flags"), F.col("portfolio_count")
    ratio = F.try_divide(
        F.try_divide(f.cast("double"), t.cast("double")),
        F.try_divide(p.cast("double"), located.cast("double")))
    enough = f.cast(wide) * located.cast(wide) >= (
        F.lit(MIN_ENRICHMENT).cast("decimal(1,0)") * (t.cast("decimal(18,0)") * p.cast("decimal(18,0)")))
    return joined.select(
        "rule_id", "cell_x", "cell_y", "flagged_count", "total_flags", "portfolio_count",
        ratio.alias("enrichment_ratio"),
        ((f >= MIN_FLAGS) & enough).alias("is_concentrated"),
    )


def any_axis() -> Column:
    return F.col("affects_hazard") | F.col("affects_vulnerability") | F.col("affects_financial")


def decision() -> Column:
    """A material axis, and either top value or concentrated."""
    hit = any_axis() & ((F.col("tiv_percentile") >= TOP) | F.col("is_concentrated"))
    return F.coalesce(hit, F.lit(False))


def priority() -> Column:
    severe = (F.col("classification") == "ERROR") & F.col("severity").isin("HIGH", "CRITICAL")
    return (
        F.when(severe & any_axis() & (F.col("tiv_percentile") >= TOP), "P1")
        .when((any_axis() & (F.col("tiv_percentile") >= UPPER)) | F.col("is_concentrated"), "P2")
        .otherwise("P3")
    )


def with_concentration(findings: DataFrame, concentrated: DataFrame) -> DataFrame:
    """Add ``is_concentrated`` (FALSE where the finding has no cell).

    Only concentrated cells are looked up: broadcast if they are few, else by a salted join, so that
    findings stay where they are or spread evenly, however many share a rule and cell.
    """
    keys = ["rule_id", "cell_x", "cell_y"]
    hits = concentrated.filter("is_concentrated").select(*keys, "is_concentrated")
    return lookup_join(findings, hits, keys).withColumn(
        "is_concentrated", F.coalesce("is_concentrated", F.lit(False)))


def scores(findings: DataFrame, concentrated: DataFrame) -> DataFrame:
    """One row per finding: axes, percentile, concentration, decision and priority."""
    return (
        with_concentration(findings, concentrated)
        .withColumns({"changes_decision": decision(), "priority": priority()})
        .select("row_id", "rule_id", "affects_hazard", "affects_vulnerability",
                "affects_financial", "tiv_percentile", "is_concentrated", "changes_decision",
                "priority")
    )


def funnel(portfolio: DataFrame, score_table: DataFrame, reference: DataFrame) -> DataFrame:
    """Exposures in total, with findings, without findings and with a P1 finding."""
    per_row = score_table.groupBy("row_id").agg(F.bool_or(F.col("priority") == "P1").alias("p1"))
    rows = portfolio.select("row_id").join(per_row, "row_id", "left").join(
        reference.select("row_id", "validated_tiv"), "row_id", "left")
    found, top = F.col("p1").isNotNull(), F.coalesce("p1", F.lit(False))
    stages = F.filter(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("Total exposures").alias("stage"), F.lit(True).alias("on")),
        F.struct(F.lit(2).alias("n"), F.lit("Exposures with findings").alias("stage"), found.alias("on")),
        F.struct(F.lit(3).alias("n"), F.lit("Exposures with no findings").alias("stage"), (~found).alias("on")),
        F.struct(F.lit(4).alias("n"), F.lit("P1 exposures").alias("stage"), top.alias("on")),
    ), lambda s: s.getField("on"))
    counted = rows.select(F.explode(stages).alias("s"), "validated_tiv").groupBy("s.n", "s.stage").agg(
        F.count("*").alias("count"), money_sum("validated_tiv").alias("tiv"))
    total = rows.agg(F.count("*").alias("n")).scalar()
    return counted.orderBy("n").select(
        "stage", "count",
        F.round(F.col("count") * 100.0 / total, 2).alias("percentage"),
        F.when(F.col("n").isin(1, 4), F.col("tiv")).alias("value_inr"),
    )
