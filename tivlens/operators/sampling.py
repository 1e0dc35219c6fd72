"""Weighted draws with replacement: each key gets one cell with probability by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tivlens.functions.columns import order_text, unit_interval
from tivlens.operators.ordering import bucketed
from tivlens.operators.sizing import BROADCAST_ROWS
from tivlens.sources.tables import materialise

WEIGHT = "decimal(28,6)"


def cell_order(x: str, y: str) -> Column:
    """One number that sorts cells by ``x``, then ``y`` (each within 31 bits)."""
    return F.shiftleft(F.col(x).cast("long"), 32) + F.col(y).cast("long")


def weight_intervals(cells: DataFrame, order: Column, weight: str, buckets: int | None = None) -> DataFrame:
    """Cells with their half-open share ``[low, high)`` of the unit interval, in the order of a unique number.

    Two levels of sums: within ranges of that order, and over the ranges before. No window spans the cells.
    """
    w = F.col(weight).cast(WEIGHT)
    split = bucketed(cells.filter(F.col(weight) > 0).withColumn("__order", order), "__order", buckets)
    inside = W.partitionBy("__bucket").orderBy("__order").rowsBetween(W.unboundedPreceding, W.currentRow)
    # one row per range
    sums = split.groupBy("__bucket").agg(F.sum(w).alias("__w"))
    up_to = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sums.select("__bucket", (F.sum("__w").over(up_to) - F.col("__w")).alias("__before"),
                          F.sum("__w").over(W.partitionBy()).alias("__total"))
    upto = (F.sum(w).over(inside)).cast("decimal(38,6)")
    total = F.col("__total").cast("double")
    return split.withColumn("__upto", upto).join(F.broadcast(offsets), "__bucket").select(
        *cells.columns,
        ((F.col("__before") + F.col("__upto") - w).cast("double") / total).alias("low"),
        ((F.col("__before") + F.col("__upto")).cast("double") / total).alias("high"))


def draw(keys: DataFrame, key: str, intervals: DataFrame, seed: int, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join each key to the cell whose interval holds its seeded uniform number ``u``.

    A guide table cuts the unit interval into as many slots as there are cells and lists a cell in
    every slot it overlaps: at most two rows a slot on average, whatever the weights, so a draw costs
    the same for ten cells and for a million. The range condition becomes an equi-join on the
    slot, and uniform numbers spread evenly over slots.
    """
    intervals = materialise(intervals, "intervals")
    n = F.lit(max(1, intervals.count()))
    guide = intervals.withColumn("__slot", F.explode(F.sequence(
        F.floor(F.col("low") * n), F.least(F.floor(F.col("high") * n), n - 1))))
    drawn = keys.withColumn("u", unit_interval(order_text(seed, label, key)))
    drawn = drawn.withColumn("__slot", F.least(F.floor(F.col("u") * n), n - 1))
    guide = F.broadcast(guide) if intervals.count() * 2 <= max_rows else guide
    hit = (F.col("low") <= F.col("u")) & (F.col("u") < F.col("high"))
    return drawn.join(guide, "__slot").filter(hit).select(*keys.columns, "u", *intervals.columns)
