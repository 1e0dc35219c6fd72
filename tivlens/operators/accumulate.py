"""Accumulation of insured value on grid points, and concentration measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tivlens.functions.columns import in_range, money, money_sum, share
from tivlens.operators.sizing import lookup_join
from tivlens.operators.spatial import GridIndex, nearest_point

MONEY_SUM = T.DecimalType(38, 4)
RADIUS = 0.177
SCENARIOS = ["DIRTY", "PRIMARY", "P003_SENSITIVITY", "P001_SENSITIVITY", "COMBINED_SENSITIVITY"]
POINT = ["grid_lon", "grid_lat"]


def critical_rows(flags: DataFrame) -> DataFrame:
    """``(row_id, has_p001, has_p003)`` of the records left out of the primary view."""
    hits = flags.filter(F.col("rule_id").isin("P-001", "P-003"))
    return hits.groupBy("row_id").agg(
        F.bool_or(F.col("rule_id") == "P-001").alias("has_p001"),
        F.bool_or(F.col("rule_id") == "P-003").alias("has_p003"))


def critical_referred(cleansed: DataFrame, flags: DataFrame) -> DataFrame:
    """Cleansed records with P-001 or P-003 and the reason they are excluded."""
    reason = (
        F.when(F.col("has_p001") & F.col("has_p003"), "P-001 and P-003 detected")
        .when(F.col("has_p001"), "P-001 unit confusion detected")
        .otherwise("P-003 single-location concentration anomaly detected"))
    return cleansed.select(
        "row_id", "location_id", "district", "latitude_clean", "longitude_clean",
        F.col("tiv_total_clean").alias("stored_tiv"),
    ).join(critical_rows(flags), "row_id").withColumn("exclusion_reason", reason)


def usable(cleansed: DataFrame, flags: DataFrame) -> DataFrame:
    """Records not quarantined, with ``has_p001`` and ``has_p003``."""
    return (
        cleansed.filter(~F.col("quarantined"))
        .join(critical_rows(flags), "row_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_p001", "has_p003")})
    )


def primary(rows: DataFrame) -> DataFrame:
    """Usable records without P-001 and P-003."""
    return rows.filter(~F.col("has_p001") & ~F.col("has_p003"))


def place(usable_rows: DataFrame, grid: GridIndex) -> DataFrame:
    """Usable records with coordinates and their nearest grid point, without a cutoff.

    The cleansed, fallback and sensitivity accumulations all start from this table.
    """
    rows = usable_rows.select(
        "row_id", "latitude_clean", "longitude_clean", "tiv_total_clean", "has_p001", "has_p003")
    return nearest_point(rows, grid, "longitude_clean", "latitude_clean")


def per_point(rows: DataFrame, value: str, by: list[str] = POINT) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("location_count"), money_sum(value).alias("total_tiv"))


def dirty(portfolio: DataFrame, grid: GridIndex, radius: float | None = RADIUS) -> DataFrame:
    rows = portfolio.filter(in_range("latitude", "longitude")).select(
        "row_id", "latitude", "longitude", "tiv_total")
    return per_point(nearest_point(rows, grid, "longitude", "latitude", radius), "tiv_total")


def cleansed_points(placed: DataFrame, radius: float | None = RADIUS) -> DataFrame:
    rows = primary(placed).filter(
        in_range("latitude_clean", "longitude_clean") & F.col("tiv_total_clean").isNotNull())
    if radius is not None:
        rows = rows.filter(F.col("grid_distance") <= F.lit(float(radius)))
    return per_point(rows, "tiv_total_clean")


def with_fallback(
    placed: DataFrame, usable_rows: DataFrame, grid: GridIndex, fallback: DataFrame
) -> DataFrame:
    """Cleansed accumulation where records without coordinates sit on their district's point."""
    actual = primary(placed).filter(
        in_range("latitude_clean", "longitude_clean") & F.col("tiv_total_clean").isNotNull()
    ).select(*POINT, "tiv_total_clean", F.lit(False).alias("assumed"))
    missing = primary(usable_rows).filter(
        F.col("tiv_total_clean").isNotNull()
        & (F.col("latitude_clean").isNull() | F.col("longitude_clean").isNull()))
    # the few fallback points are placed, not the records that use them
    spots = nearest_point(
        fallback.filter("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"),
        grid, "longitude", "latitude").select("district", *POINT)
    assumed = lookup_join(
        missing.select("row_id", "district", "tiv_total_clean"), spots, ["district"], "inner"
    ).select(*POINT, "tiv_total_clean", F.lit(True).alias("assumed"))
    return actual.unionByName(assumed).groupBy(*POINT).agg(
        F.count("*").alias("location_count"),
        money_sum("tiv_total_clean").alias("total_tiv"),
        F.count_if("assumed").alias("assumed_location_count"),
        money_sum(F.when(F.col("assumed"), F.col("tiv_total_clean"))).alias("assumed_tiv"),
    )


def _largest(cells: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest values (absent ones first), found by a top-n per task."""
    return cells.select("total_tiv").orderBy(F.col("total_tiv").desc_nulls_first()).limit(n)


def fallback_comparison(conservative: DataFrame, fallback: DataFrame) -> DataFrame:
    """Totals and top-10 share with and without the assumed locations."""

    def line(cells: DataFrame, name: str, extra: list[Column]) -> DataFrame:
        # the tenth value; equal ones belong to the top, and below ten points all do
        bound = _largest(cells, 10).agg(
            F.min("total_tiv").alias("tenth"))
        top = F.when(F.col("total_tiv") >= F.col("tenth"), F.col("total_tiv"))
        return cells.join(F.broadcast(bound)).agg(
            F.lit(name).alias("scenario"),
            F.sum("location_count").alias("locations"),
            money_sum("total_tiv").alias("portfolio_tiv"),
            money_sum(top).alias("top10_tiv"),
            *extra,
        ).withColumn("top10_tiv_share_pct", share(F.col("top10_tiv"), F.col("portfolio_tiv")) * 100)

    columns = ["scenario", "locations", "portfolio_tiv", "top10_tiv", "top10_tiv_share_pct",
               "assumed_locations", "assumed_tiv"]
    a = line(conservative, "CONSERVATIVE", [])
    b = line(fallback, "DISTRICT_FALLBACK", [
        F.sum("assumed_location_count").alias("assumed_locations"),
        money_sum("assumed_tiv").alias("assumed_tiv")])
    return b.unionByName(a, allowMissingColumns=True).select(*columns)


def _status(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("portfolio_status"), *POINT, "location_count", "total_tiv")


def both_statuses(dirty_points: DataFrame, clean_points: DataFrame) -> DataFrame:
    return _status(dirty_points, "DIRTY").unionByName(_status(clean_points, "CLEANSED"))


def totals(points: DataFrame, by: str = "portfolio_status") -> DataFrame:
    return points.groupBy(by).agg(
        F.count("*").alias("grid_cells"), F.sum("location_count").alias("locations"),
        money_sum("total_tiv").alias("portfolio_tiv"))


def top_points(points: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest points of each status, ties included.

    The rank is limited in every task before rows meet, so no task sees all points.
    """
    rank = F.rank().over(W.partitionBy("portfolio_status").orderBy(F.col("total_tiv").desc_nulls_first()))
    return points.withColumn("tiv_rank", rank).filter(F.col("tiv_rank") <= n)


def concentration(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Top-1/3/5 shares, HHI and occupied cells, overall or per ``by``.

    One aggregate gives totals and squares; the five largest values of each group
    come from a top-n that every task applies first.
    """
    by = by or []
    v = F.col("total_tiv")
    facts = points.groupBy(*by).agg(
        money_sum("total_tiv").alias("portfolio_tiv"), F.sum(v * v).alias("squares"),
        F.count("*").alias("occupied_cells"))
    if by:
        order = W.partitionBy(*by).orderBy(v.desc_nulls_first())
        five = points.select(*by, "total_tiv").withColumn("n", F.row_number().over(order)).filter("n <= 5")
    else:
        five = _largest(points, 5)
    # absent values count as the largest, as in the rank
    largest = five.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct(v.isNull().alias("absent"), v.alias("v"))), asc=False).alias("five"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = facts.alias("a").join(F.broadcast(largest.alias("b")), reduce(Column.__and__, same, F.lit(True)))

    def top(n: int) -> Column:
        part = F.aggregate(F.slice("five", 1, n), F.lit(None).cast(MONEY_SUM), lambda total, x: F.when(
            x["v"].isNotNull(), (F.coalesce(total, F.lit(0)) + money(x["v"])).cast(MONEY_SUM)).otherwise(total))
        return share(part, F.col("portfolio_tiv"))

    return joined.select(
        *[F.col(f"a.{c}").alias(c) for c in by], "portfolio_tiv",
        top(1).alias("top1_share"), top(3).alias("top3_share"), top(5).alias("top5_share"),
        F.try_divide(F.col("squares"), F.col("portfolio_tiv") * F.col("portfolio_tiv")).alias("hhi"),
        "occupied_cells",
    )


def sensitivity(placed: DataFrame) -> DataFrame:
    """Accumulation per scenario. Each record is aggregated once per combination of
    scenarios; the combinations are expanded after that."""
    p1, p3 = F.col("has_p001"), F.col("has_p003")
    combined = placed.groupBy("has_p001", "has_p003", *POINT).agg(
        F.count("*").alias("n"), F.sum(money("tiv_total_clean")).alias("tiv"))
    member = F.array_compact(F.array(
        F.when(~p1 & ~p3, "PRIMARY"),
        F.when(p1 | ~p3, "P001_SENSITIVITY"),
        F.when(p3 | ~p1, "P003_SENSITIVITY"),
        F.lit("COMBINED_SENSITIVITY"),
    ))
    return combined.withColumn("scenario", F.explode(member)).groupBy("scenario", *POINT).agg(
        F.sum("n").alias("location_count"), F.sum("tiv").cast("double").alias("total_tiv"))


def sensitivity_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("scenario").agg(
        F.count("*").alias("grid_cells"), F.sum("location_count").alias("spatial_locations"),
        money_sum("total_tiv").alias("spatial_tiv")).orderBy("scenario")


def comparison(dirty_points: DataFrame, clean_points: DataFrame) -> DataFrame:
    """Dirty and cleansed accumulation side by side with the change."""
    d = dirty_points.select(*POINT, F.col("location_count").alias("dl"), F.col("total_tiv").alias("dt"))
    c = clean_points.select(*POINT, F.col("location_count").alias("cl"), F.col("total_tiv").alias("ct"))
    zero, none = F.lit(0.0), F.lit(0)
    # subtracted as money: exact, unlike the difference of two large doubles
    change = (money("cleansed_tiv") - money("dirty_tiv")).cast("double")
    return (
        d.join(c, POINT, "full_outer")
        .select(
            *POINT,
            F.coalesce("dl", none).alias("dirty_locations"),
            F.coalesce("cl", none).alias("cleansed_locations"),
            F.coalesce("dt", zero).alias("dirty_tiv"),
            F.coalesce("ct", zero).alias("cleansed_tiv"),
        )
        .withColumn("tiv_change", change)
        .withColumn("tiv_change_pct", share(F.col("tiv_change") * 100, F.nullif(F.col("dirty_tiv"), zero)))
    )


def largest_changes(compared: DataFrame, n: int = 20) -> DataFrame:
    return compared.orderBy(F.abs("tiv_change").desc_nulls_first(), *POINT).limit(n)


def by_attribute(
    portfolio: DataFrame, usable_rows: DataFrame, raw: str, clean: str
) -> DataFrame:
    """Locations and value per attribute before and after cleansing."""
    before = portfolio.groupBy(raw).agg(
        F.count("*").alias("location_count"), money_sum("tiv_total").alias("total_tiv"))
    after = primary(usable_rows).groupBy(F.col(clean).alias(raw)).agg(
        F.count("*").alias("location_count"), money_sum("tiv_total_clean").alias("total_tiv"))
    columns = ["portfolio_status", raw, "location_count", "total_tiv"]
    return before.withColumn("portfolio_status", F.lit("DIRTY")).unionByName(
        after.withColumn("portfolio_status", F.lit("CLEANSED"))).select(*columns)


def scenario_points(dirty_points: DataFrame, sensitivities: DataFrame) -> DataFrame:
    """DIRTY and all sensitivity scenarios as ``(scenario, grid_lon, grid_lat, total_tiv)``."""
    columns = ["scenario", *POINT, "total_tiv"]
    return dirty_points.withColumn("scenario", F.lit("DIRTY")).select(*columns).unionByName(
        sensitivities.select(*columns))


def impact_summary(points: DataFrame) -> DataFrame:
    """Concentration of every scenario, in reporting order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCENARIOS]), F.col("scenario"))
    return concentration(points, ["scenario"]).orderBy(F.when(rank > 0, rank).otherwise(99))
