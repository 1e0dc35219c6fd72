"""Every registered query against its SQL counterpart on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import connect, from_duckdb, from_spark

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, con, name):
    assert from_spark(QUERIES[name](spark, SF_DIR)) == from_duckdb(con, ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and entry.entry(spark).columns == ["rule_id", "flags"]
