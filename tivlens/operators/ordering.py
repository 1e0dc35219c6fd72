"""Global order statistics without a single-partition window.

Values are grouped first (ties and hot values collapse map-side), then split
into ordered buckets at approximate quantiles. The bucket bounds only steer the
split: results are exact for any bounds. Offsets between buckets come from a
table with one row per bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

MAX_BUCKETS = 4096


def _bounds(values: DataFrame, column: str, buckets: int) -> list[float]:
    cuts = [i / buckets for i in range(1, buckets)]
    if not cuts:
        return []
    row = values.agg(
        F.percentile_approx(F.col(column).cast("double"), cuts, F.lit(max(1000, buckets * 10)))
    ).first()
    return sorted(set(row[0] or []))


def bucketed(values: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Add ``__bucket``: order-preserving bucket number of a numeric column."""
    if buckets is None:
        buckets = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(values, column, min(buckets, MAX_BUCKETS))
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return values.withColumn("__bucket", F.lit(0.0))
    keyed = values.withColumn("__value", F.col(column).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket")
    return cut.transform(keyed).drop("__value")


def rows_before(
    values: DataFrame,
    column: str,
    weight: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``before``, the weight of the rows with a strictly smaller value, and ``total``.

    ``column`` must be unique and not NULL in ``values``; ``weight`` (default 1)
    is the number of rows a value stands for.
    """
    w = F.col(weight) if weight else F.lit(1)
    split = bucketed(values, column, buckets)
    inside = W.partitionBy("__bucket").orderBy(F.col(column).asc())
    local = F.coalesce(
        F.sum(w).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    # one row per bucket, so the unpartitioned window below is bounded
    sums = split.groupBy("__bucket").agg(F.sum(w).alias("__w"))
    up_to = W.orderBy(F.col("__bucket").asc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy(F.col("__bucket").asc()).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    offsets = sums.select(
        "__bucket",
        (F.sum("__w").over(up_to) - F.col("__w")).alias("__offset"),
        F.sum("__w").over(everything).cast("long").alias("total"),
    )
    return (
        split.withColumn("__local", local)
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("before", (F.col("__local") + F.col("__offset")).cast("long"))
        .drop("__bucket", "__local", "__offset")
    )


def value_counts(df: DataFrame, column: str, count_col: str = "n") -> DataFrame:
    """One row per distinct non-NULL value with its multiplicity."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(count_col))
    )


def exact_median(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """One row ``(median, maximum)``; the median of an even count is the mean of the middle two."""
    counted = rows_before(value_counts(df, column), column, "n", buckets)
    low = F.floor((F.col("total") - 1) / 2)
    high = F.ceil((F.col("total") - 1) / 2)

    def at(rank):
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    v = F.col(column).cast("double")
    return counted.agg(
        ((F.max(F.when(at(low), v)) + F.max(F.when(at(high), v))) / 2).alias("median"),
        F.max(v).alias("maximum"),
    )


def row_numbers(df: DataFrame, key: str, name: str = "row_id") -> DataFrame:
    """Dense ids 1..N in the order of a unique numeric key."""
    return rows_before(df, key).withColumn(name, F.col("before") + 1).drop("before", "total")


def hash_ranks(df: DataFrame, order_col: str, name: str) -> DataFrame:
    """Dense ranks 1..N in the order of a uniform hex text (see ``order_text``).

    The first four digits split the rows evenly into at most 65,536 ordered
    buckets, so no sampling pass is needed.
    """
    split = df.withColumn("__bucket", F.substring(order_col, 1, 4))
    sums = split.groupBy("__bucket").agg(F.count("*").alias("__w"))
    ahead = W.orderBy(F.col("__bucket").asc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "__bucket", F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy("__bucket").orderBy(F.col(order_col).asc())
    return (
        split.withColumn("__local", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(name, (F.col("__local") + F.col("__offset")).cast("long"))
        .drop("__bucket", "__local", "__offset")
    )
