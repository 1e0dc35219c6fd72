"""Detection quality against ground truth, on distinct (row_id, rule_id) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tivlens.functions.columns import ratio
from tivlens.model import DIMENSION_ORDER, ERROR_TYPES
from tivlens.operators import expect


def map_rules(truth: DataFrame, rule_of: dict[str, str] | None = None) -> DataFrame:
    """Add ``rule_id`` from ``error_type``; NULL for a type without a rule."""
    names = rule_of or {e: r for r, e in ERROR_TYPES.items()}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return truth.withColumn("rule_id", F.try_element_at(mapping, F.col("error_type")))


def require_mapped(truth: DataFrame) -> DataFrame:
    """``map_rules`` that raises on unmapped error types and names them."""
    mapped = map_rules(truth)
    lost = mapped.filter("rule_id IS NULL").select("error_type").distinct().collect()
    if lost:
        raise expect.ContractError(
            f"unmapped error types: {sorted(str(r['error_type']) for r in lost)}")
    return mapped


def distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select("row_id", "rule_id").distinct()


def outcomes(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """One row per pair with ``tp, fp, fn``; one shuffle of the tagged union, no join."""
    tagged = truth.select("row_id", "rule_id", F.lit(True).alias("t")).unionByName(
        detected.select("row_id", "rule_id", F.lit(False).alias("t")))
    t, d = F.bool_or("t"), F.bool_or(~F.col("t"))
    return tagged.groupBy("row_id", "rule_id").agg(t.alias("t"), d.alias("d")).select(
        "row_id", "rule_id",
        (F.col("t") & F.col("d")).alias("tp"),
        (~F.col("t") & F.col("d")).alias("fp"),
        (F.col("t") & ~F.col("d")).alias("fn"),
    )


def _confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rule_id").agg(
        F.count_if("tp").alias("TP"), F.count_if("fp").alias("FP"), F.count_if("fn").alias("FN"))


def _precision() -> Column:
    return ratio(F.col("TP"), F.col("TP") + F.col("FP"))


def _recall() -> Column:
    return ratio(F.col("TP"), F.col("TP") + F.col("FN"))


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"precision": _precision(), "recall": _recall()})


def by_rule(truth: DataFrame, detected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts and ratios per rule, for every rule of the catalogue, in rule order."""
    found = _confusion(outcomes(truth, detected))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("TP", "FP", "FN")]
    full = F.broadcast(catalogue.select("rule_id", "error_type")).join(found, "rule_id", "left")
    return with_ratios(full.select("rule_id", "error_type", *zero)).orderBy("rule_id")


def _is_completeness() -> Column:
    return F.col("rule_id").like("C-00_")


def overall(rule_counts: DataFrame) -> DataFrame:
    """Scopes ``all`` and ``completeness_excluded`` from per-rule counts."""
    scopes = F.when(_is_completeness(), F.array(F.lit("all"))).otherwise(
        F.array(F.lit("all"), F.lit("completeness_excluded")))
    sums = [F.sum(c).alias(c) for c in ("TP", "FP", "FN")]
    return with_ratios(
        rule_counts.select(F.explode(scopes).alias("scope"), "TP", "FP", "FN")
        .groupBy("scope").agg(*sums))


def completeness_coverage(rule_counts: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("TP", "FP", "FN")]
    return rule_counts.filter(_is_completeness()).agg(*sums).withColumn("coverage", _recall())


def by_dimension(rule_counts: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts and ratios per dimension, in reporting order. A rule's dimension comes from its events."""
    dimension = truth.groupBy("rule_id").agg(F.min("dimension").alias("dimension"))
    rank = F.array_position(F.array(*[F.lit(d) for d in DIMENSION_ORDER]), F.col("dimension"))
    sums = [F.sum(c).alias(c) for c in ("TP", "FP", "FN")]
    joined = rule_counts.select("rule_id", "TP", "FP", "FN").join(dimension, "rule_id")
    return with_ratios(joined.groupBy("dimension").agg(*sums)).orderBy(rank)


def summary_lines(rule_counts: DataFrame, title: str = "Detection evaluation summary") -> DataFrame:
    """The text report as ``(position, line)``."""
    comp = _is_completeness()

    def s(c: str, cond: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col(c) if cond is None else F.when(cond, F.col(c))), F.lit(0))

    sums = rule_counts.agg(*[
        s(c, cond).alias(f"{c}_{k}")
        for k, cond in (("all", None), ("inj", ~comp), ("com", comp)) for c in ("TP", "FP", "FN")])

    def n(name: str) -> Column:
        return F.col(name).cast("string")

    def pct(num: str, *den: str) -> Column:
        total = sum((F.col(d) for d in den[1:]), F.col(den[0]))
        return F.format_string("%.6f%%", ratio(F.col(num), total) * 100)

    def block(heading: str, k: str) -> list:
        return [F.lit(""), F.lit(heading)] + [
            F.concat(F.lit(f"{c}: "), n(f"{c}_{k}")) for c in ("TP", "FP", "FN")]

    def both(k: str) -> list:
        return [F.concat(F.lit("Precision: "), pct(f"TP_{k}", f"TP_{k}", f"FP_{k}")),
                F.concat(F.lit("Recall: "), pct(f"TP_{k}", f"TP_{k}", f"FN_{k}"))]

    lines = [
        F.lit(title), F.lit("=" * len(title)), F.lit(""),
        F.concat(F.lit("Ground-truth pairs: "), (F.col("TP_all") + F.col("FN_all")).cast("string")),
        F.concat(F.lit("Detected pairs: "), (F.col("TP_all") + F.col("FP_all")).cast("string")),
        *block("Overall detection", "all"), *both("all"),
        *block("Injected-error evaluation (completeness excluded)", "inj"), *both("inj"),
        *block("Completeness", "com"),
        F.concat(F.lit("Coverage: "), pct("TP_com", "TP_com", "FN_com")),
    ]
    return sums.select(F.posexplode(F.array(*lines)).alias("position", "line")).withColumn(
        "position", F.col("position").cast("long"))
