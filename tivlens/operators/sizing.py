"""Joins that broadcast only what has been measured.

A reference table is broadcast when a bounded probe proves it small. Beyond the
bound the join is a shuffle join whose fact side is salted, so a single hot key
cannot land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
SALTS = 64


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    reference: DataFrame,
    keys: list[str],
    how: str = "left",
    *,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a reference on ``keys`` (``left`` or ``inner``)."""
    if is_small(reference, max_rows):
        return facts.join(F.broadcast(reference), keys, how)
    return salted_join(facts, reference, keys, how, salts)


def salted_join(
    facts: DataFrame, reference: DataFrame, keys: list[str], how: str, salts: int = SALTS
) -> DataFrame:
    """Shuffle join with every reference row repeated once per salt."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(salts)).cast("int")
    left = facts.withColumn("__salt", spread)
    right = reference.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
