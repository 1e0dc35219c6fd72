"""Frozen thresholds from a clean baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tivlens.operators.detect import Threshold
from tivlens.operators.ordering import exact_median

BASELINE = "clean_baseline"


def calibrate(df: DataFrame, value: Column, where: Column, name: str = BASELINE) -> DataFrame:
    """One row ``(reference_name, median, multiplier, threshold, clean_max)``.

    The threshold is the smallest whole multiple of the median above the maximum.
    """
    stats = exact_median(df.filter(where).select(value.cast("double").alias("v")), "v")
    multiplier = F.floor(F.col("maximum") / F.col("median")) + 1
    return stats.select(
        F.lit(name).alias("reference_name"),
        "median",
        multiplier.alias("multiplier"),
        (multiplier * F.col("median")).alias("threshold"),
        F.col("maximum").alias("clean_max"),
    )


def calibrate_density(clean: DataFrame, name: str = BASELINE) -> DataFrame:
    """X-005 reference: building value per square metre."""
    per_sqm = F.try_divide("tiv_building", "floor_area_sqm")
    return calibrate(
        clean, per_sqm, (F.col("floor_area_sqm") > 0) & F.col("tiv_building").isNotNull(), name)


def calibrate_building_tiv(clean: DataFrame, name: str = BASELINE) -> DataFrame:
    """P-001 reference: building value."""
    return calibrate(clean, F.col("tiv_building"), F.col("tiv_building") > 0, name)


SKETCH_SIZE = 200


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far, as a share of the rows, a KLL sketch's quantile may be off in rank (with 99 % confidence)."""
    return 2.296 / size ** 0.9021


def calibrate_sketched(
    df: DataFrame, value: Column, where: Column, name: str = BASELINE, size: int = SKETCH_SIZE
) -> DataFrame:
    """``calibrate`` from a mergeable sketch: one pass, and sketches of parts can be kept and merged.

    ``median`` is approximate; ``median_low`` and ``median_high`` are the values a rank error of
    ``rank_error`` below and above. Maximum, and so the ratio's numerator, is exact.
    """
    v, off = value.cast("double"), rank_error(size)
    seen = df.filter(where).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("s"), F.max(v).alias("clean_max"))

    def at(q: float) -> Column:
        return F.kll_sketch_get_quantile_double("s", F.lit(q))

    median = at(0.5)
    multiplier = F.floor(F.col("clean_max") / F.col("median")) + 1
    return seen.select(median.alias("median"), at(max(0.0, 0.5 - off)).alias("median_low"),
                       at(min(1.0, 0.5 + off)).alias("median_high"), "clean_max").select(
        F.lit(name).alias("reference_name"), "median", "median_low", "median_high", multiplier.alias("multiplier"),
        (multiplier * F.col("median")).alias("threshold"), "clean_max", F.lit(off).alias("rank_error"))


def read_threshold(reference: DataFrame, name: str = BASELINE) -> Threshold:
    """The named reference row as plain numbers (one row by key)."""
    row = reference.filter(F.col("reference_name") == name).first()
    if row is None:
        raise ValueError(f"no reference named {name!r}")
    return Threshold(row["median"], row["multiplier"], row["threshold"], row["clean_max"])


def materiality_reference(
    clean: DataFrame, basis: str = "authoritative_clean_portfolio"
) -> DataFrame:
    """``(row_id, validated_tiv, validation_basis)`` from a trusted portfolio."""
    return clean.select(
        "row_id", F.col("tiv_total").alias("validated_tiv"), F.lit(basis).alias("validation_basis"))
