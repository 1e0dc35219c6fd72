"""Data-contract checks. Each returns one row ``(check, ok, observed, expected)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tivlens.functions.columns import money, money_sum


class ContractError(ValueError):
    """A checked expectation does not hold."""


def _row(df: DataFrame, name: str, observed: Column, expected: Column, ok: Column) -> DataFrame:
    return df.agg(observed.alias("__o"), expected.alias("__e")).select(
        F.lit(name).alias("check"), ok.alias("ok"),
        F.col("__o").cast("double").alias("observed"),
        F.col("__e").cast("double").alias("expected"),
    )


def _constant(value: float) -> Column:
    """A literal that may stand among aggregates, also of no rows."""
    return F.coalesce(F.max(F.lit(float(value))), F.lit(float(value)))


def _equal(df: DataFrame, name: str, observed: Column, expected: float) -> DataFrame:
    return _row(df, name, observed, _constant(expected),
                F.col("__o").cast("double") == F.lit(float(expected)))


def row_count(df: DataFrame, expected: int, name: str = "row_count") -> DataFrame:
    return _equal(df, name, F.count("*"), expected)


def no_nulls(df: DataFrame, column: str) -> DataFrame:
    return _equal(df, f"{column}_not_null", F.count_if(F.col(column).isNull()), 0)


def positive(df: DataFrame, column: str) -> DataFrame:
    return _equal(df, f"{column}_positive", F.count_if(F.col(column) <= 0), 0)


def money_fits(df: DataFrame, column: str) -> DataFrame:
    """No value is lost to sums of money: not a number, infinite or beyond its range."""
    lost = F.col(column).isNotNull() & money(column).isNull()
    return _equal(df, f"{column}_fits_money", F.count_if(lost), 0)


class Watch:
    """Checks without a grouping, measured while a table is written instead of by a pass of their own.

    ``on`` adds the measurements to a DataFrame; once an action on it is done, ``results`` has the checks.
    """

    def __init__(self) -> None:
        self._measured: dict[str, Column] = {}
        self._expected: dict[str, float] = {}
        self._seen = Observation()

    def _add(self, name: str, observed: Column, expected: float) -> Watch:
        self._measured[name], self._expected[name] = observed.cast("double"), float(expected)
        return self

    def row_count(self, expected: int) -> Watch:
        return self._add("row_count", F.count("*"), expected)

    def no_nulls(self, column: str) -> Watch:
        return self._add(f"{column}_not_null", F.count_if(F.col(column).isNull()), 0)

    def positive(self, column: str) -> Watch:
        return self._add(f"{column}_positive", F.count_if(F.col(column) <= 0), 0)

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, *[c.alias(n) for n, c in self._measured.items()])

    def results(self) -> list[tuple[str, bool, float, float]]:
        """``(check, ok, observed, expected)`` of every check."""
        seen = self._seen.get
        return [(n, seen[n] == e, seen[n], e) for n, e in self._expected.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.results(), "check string, ok boolean, observed double, expected double")

    def enforce(self) -> None:
        """Raise if a check failed, as ``enforce`` does for checks that are queries."""
        failed = [f"{n}: observed {o:g}, expected {e:g}" for n, ok, o, e in self.results() if not ok]
        if failed:
            raise ContractError("; ".join(failed))


def well_formed(scan: DataFrame) -> DataFrame:
    """Fields of a scan with ``errors="keep"`` that are not of their type, and lines that are no record. One pass."""
    counts = {"fields_well_formed": F.coalesce(F.sum(F.size("malformed")), F.lit(0)),
              "records_well_formed": F.count("bad_record")}
    zero = F.lit(0.0)
    checks = F.array(*[
        F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("ok"), F.col(n).cast("double").alias("observed"),
                 zero.alias("expected")) for n in counts])
    return scan.agg(*[v.alias(n) for n, v in counts.items()]).select(F.inline(checks))


def unmapped(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Codes of ``df`` missing from ``codes``: one row per code with its number of rows."""
    return (
        df.groupBy(column).agg(F.count("*").alias("rows"))
        .join(codes.select(column).distinct(), column, "left_anti")
    )


def all_mapped(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    return _equal(unmapped(df, codes, column), f"{column}_mapped", F.count("*"), 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def unique(df: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    return _equal(duplicates(df, keys), name or f"{'_'.join(keys)}_unique", F.count("*"), 0)


def _one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    return left.join(right, keys, "full_outer").filter("__a IS NULL OR __b IS NULL")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _equal(_one_sided(a, b, keys), "same_keys", F.count("*"), 0)


def close_values(
    a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, tolerance: float = 1e-6
) -> DataFrame:
    """The largest difference over the common keys is within the tolerance."""
    both = a.select(*keys, F.col(left).alias("__l")).join(
        b.select(*keys, F.col(right).alias("__r")), keys)
    gap = F.coalesce(F.max(F.abs(F.col("__l") - F.col("__r"))), F.lit(0.0))
    return _row(both, "values_agree", gap, _constant(tolerance),
                F.col("__o") <= F.lit(float(tolerance)))


def all_found(facts: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Every fact row has its reference row."""
    lost = facts.select(*keys).join(reference.select(*keys).distinct(), keys, "left_anti")
    return _equal(lost, "reference_found", F.count("*"), 0)


foreign_key = all_found


def present(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """All required categories occur."""
    seen = F.count_distinct(F.when(F.col(column).isin(values), F.col(column)))
    return _equal(df, f"{column}_present", seen, len(set(values)))


def differs(df: DataFrame, scenario: str, baseline: str, value: str) -> DataFrame:
    """The total of a scenario differs from the total of its baseline."""

    def total(name: str) -> Column:
        return money_sum(F.when(F.col("scenario") == name, F.col(value)))

    return _row(df, f"{scenario}_differs_from_{baseline}", total(scenario), total(baseline),
                ~F.col("__o").eqNullSafe(F.col("__e")))


def profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Row count, key range and value sum after a load."""
    return df.agg(
        F.count("*").alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"),
        money_sum(value).alias("total"),
    )


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per combination, TRUE before FALSE for booleans."""
    order = [F.col(c).desc() if dict(df.dtypes)[c] == "boolean" else F.col(c).asc() for c in columns]
    return df.groupBy(*columns).agg(F.count("*").alias("flags")).orderBy(*order)


def enforce(*checks: DataFrame) -> None:
    """Raise when a check failed. All checks run as one job and return one row each."""
    failed = reduce(DataFrame.unionByName, checks).filter(~F.coalesce("ok", F.lit(False))).collect()
    if failed:
        raise ContractError("; ".join(
            f"{r['check']}: observed {r['observed']}, expected {r['expected']}" for r in failed))
