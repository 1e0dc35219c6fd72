"""Join rows back to the statistics of their group without trusting the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tivlens.operators.sizing import is_small

#: Keys with more rows than this are joined by broadcast. There are at most
#: (all rows / HOT_ROWS) of them: 200,000 keys in a table of 10**12 rows.
HOT_ROWS = 5_000_000


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size_col: str,
    qualify: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with the groups that ``qualify`` (all by default).

    ``groups`` has one row for every key of ``rows``, aggregated (so a hot key was
    combined map-side), with the number of rows behind the key in ``size_col``.
    Hot keys are few by arithmetic: they are broadcast, joined if they qualify and
    dropped if not, and their rows are never shuffled. Every key left for the
    shuffle has at most ``hot_rows`` rows, which one task can hold.
    """
    qualify = F.lit(True) if qualify is None else F.coalesce(qualify, F.lit(False))
    hot = groups.filter(F.col(size_col) > hot_rows)
    cold = groups.filter((F.col(size_col) <= hot_rows) & qualify)
    hot_joined = rows.join(F.broadcast(hot.filter(qualify)), keys, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_joined.unionByName(cold_rows.join(cold, keys, "inner"))


def join_stored(
    rows: DataFrame, groups: DataFrame, keys: list[str], max_rows: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with a stored table of qualifying groups, marked ``hot`` or not.

    A small table is broadcast, so ``rows`` are read once and not shuffled. Beyond that only the
    hot groups are, and only if there are any does ``rows`` have to be read a second time.
    """
    if is_small(groups) if max_rows is None else is_small(groups, max_rows):
        return rows.join(F.broadcast(groups.drop("hot")), keys, "inner")
    hot, cold = groups.filter("hot").drop("hot"), groups.filter("NOT hot").drop("hot")
    if hot.isEmpty():
        return rows.join(cold, keys, "inner")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys, "inner").unionByName(others.join(cold, keys, "inner"))
