"""Tables of records are joined and grouped on row_id without an exchange."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tivlens.operators import materiality, treat
from tivlens.registry.spark_queries import QUERIES
from tivlens.registry.workspace import workspace
from tivlens.sources.tables import materialise, store_bucketed

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def without_broadcasts(spark):
    """As with tables that are too large for it."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exchanges(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(rf"Exchange hashpartitioning\({column}#[^)]*\)", plan)


@pytest.mark.parametrize("name", ["m01_materiality_tiv", "m05_enriched_findings", "m11_scores",
                                  "t01_findings_with_priority", "t14_cleansed", "u01_critical_referred"])
def test_no_exchange_on_row_id(spark, name):
    w = workspace(spark, SF_DIR)
    assert w.cleansed.count() == w.portfolio.count()  # the tables before it are stored
    with without_broadcasts(spark):
        assert exchanges(QUERIES[name](spark, SF_DIR), "row_id") == []


def test_whole_chain_from_flags_to_records(spark):
    """Findings, scores and treatment as one plan on stored flags and portfolio: still none."""
    w = workspace(spark, SF_DIR)
    with without_broadcasts(spark):
        found = materiality.enriched_findings(w.flags, w.portfolio, w.validated, w.catalogue, w.percentile)
        scores = materiality.scores(found, w.concentration)
        done = treat.treat(w.portfolio, w.flags, w.catalogue, scores)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(row_id", plan)
        assert done.exceptAll(w.cleansed).count() == 0


def test_plain_tables_give_the_same(spark):
    w = workspace(spark, SF_DIR)
    plain = [materialise(df, "plain") for df in (w.flags, w.portfolio, w.scores)]
    got = treat.treat(plain[1], plain[0], w.catalogue, plain[2])
    with without_broadcasts(spark):
        assert len(exchanges(treat.treat(plain[1], plain[0], w.catalogue, plain[2]), "row_id")) == 3  # what buckets save
    assert got.exceptAll(w.cleansed).count() == 0 and w.cleansed.exceptAll(got).count() == 0


def test_bucketed_table_is_whole_and_plain_parquet(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 100).alias("row_id"), F.lit("x").alias("v"))
    stored = store_bucketed(df, f"{tmp_path}/t", buckets=4)
    assert stored.exceptAll(df).count() == 0 and stored.count() == 1000
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4
    empty = store_bucketed(df.limit(0), f"{tmp_path}/e")
    assert empty.count() == 0 and empty.columns == df.columns
