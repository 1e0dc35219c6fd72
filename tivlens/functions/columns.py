"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Row-level money. Sums of it become DECIMAL(38, 4), so totals never depend on
#: the order in which partitions are added up.
MONEY = T.DecimalType(28, 4)


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def norm(name: str | Column) -> Column:
    """Lower-cased, trimmed text."""
    return F.lower(F.trim(col(name)))


def blank(name: str | Column) -> Column:
    """NULL or nothing but spaces."""
    return col(name).isNull() | (F.trim(col(name)) == "")


def money(name: str | Column) -> Column:
    """The value as money; NULL where it is no number or too large (``expect.money_fits`` counts those)."""
    return col(name).try_cast(MONEY)


def money_sum(name: str | Column) -> Column:
    """Exact sum of a money column, returned as DOUBLE."""
    return F.sum(money(name)).cast("double")


def fixed(name: str | Column, scale: int) -> Column:
    """Text with a fixed number of decimals (independent of the double printer).

    A value that doesn't fit, infinity or not a number is written as the double it is.
    """
    value = col(name)
    return F.coalesce(value.try_cast(T.DecimalType(28, scale)).cast("string"), value.cast("string"))


def text(*parts: str | Column) -> Column:
    """Concatenate, treating NULL as the empty string. Plain strings are literals."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def share(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL where the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def in_range(lat: str | Column, lon: str | Column) -> Column:
    """Both coordinates present and inside the valid degree range."""
    return (
        col(lat).isNotNull() & col(lon).isNotNull()
        & col(lat).between(-90, 90) & col(lon).between(-180, 180)
    )


def cell(name: str | Column, size: float) -> Column:
    """Index of the square cell a coordinate falls in."""
    return F.floor(col(name) / F.lit(float(size)))


def key8(name: str | Column) -> Column:
    """Coordinate rounded to 8 decimals: the only form used as a grid join key.

    Adding 0.0 turns -0.0 into 0.0.
    """
    return F.round(col(name).cast("double"), 8) + F.lit(0.0)


def order_text(seed: int, label: str, key: str | Column) -> Column:
    """A reproducible pseudo-random ordering key: 32 hex digits of md5."""
    return F.md5(text(f"{seed}|{label}|", col(key).cast("string")))


def unit_interval(hex_text: Column) -> Column:
    """Uniform number in [0, 1) from the first 12 hex digits of an ordering key."""
    return F.conv(F.substring(hex_text, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def pick(values: list[str], hex_text: Column) -> Column:
    """One of ``values``, chosen by digits 13-19 of an ordering key."""
    index = F.conv(F.substring(hex_text, 13, 7), 16, 10).cast("int") % len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)
