"""The shared pass of the group rules: against pairs of rows, on both join paths, and its plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tivlens.model import PORTFOLIO
from tivlens.operators import detect
from tivlens.registry.spark_queries import QUERIES
from tivlens.registry.workspace import workspace

SF_DIR = "/root/testdata/sf0.001"


def portfolio(spark, n=400, seed=2):
    """Few distinct values, so that all kinds of groups occur; a third of the rows is one record."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        r = {f.name: None for f in PORTFOLIO.fields} | {"row_id": i, "account_id": "A"}
        if i % 3 == 0:
            r |= {"location_id": "L0", "latitude": 1.5, "longitude": -0.0, "tiv_building": 5.0, "tiv_total": 3e6,
                  "geocode_level": "POSTCODE "}
        else:
            r |= {"location_id": rnd.choice([None, *(f"L{k}" for k in range(40))]),
                  "latitude": rnd.choice([None, 0.0, -0.0, float("nan"), 1.5, 2.25]),
                  "longitude": rnd.choice([0.0, 1.0, 2.0, 7.0]),
                  "tiv_building": rnd.choice([None, 5.0, 6.0, float("inf")]),
                  "tiv_total": rnd.choice([None, -2e6, 0.0, 1e6, 1e6 + 0.4, 1e6 - 0.6, 4e6 + 2, 2e6, 1e30, float("nan")]),
                  "geocode_level": rnd.choice([None, "EXACT", "postcode"]),
                  "city": rnd.choice([None, "", "x"]), "account_id": rnd.choice([None, "A"])}
        rows.append(tuple(r[f.name] for f in PORTFOLIO.fields))
    return spark.createDataFrame(rows, PORTFOLIO)


def by_pairs(rows):
    """Every rule by looking at all other rows."""
    nan = lambda v: "nan" if v is not None and v != v else v
    same = ["account_id", "location_id", *detect.SAME_TEXT, *detect.SAME_NUMBERS]

    def content(r):
        return tuple((nan(r[c]) if r[c] is not None else (-999.0 if c in detect.SAME_NUMBERS else "")) for c in same)

    def rounded(r):
        t = r["tiv_total"]
        return None if t is None or t != t or abs(t) > 1e23 else int(abs(t) + 0.5) * (1 if t >= 0 else -1)

    found = set()
    for r in rows:
        i, t = r["row_id"], r["tiv_total"]
        named = r["location_id"] is not None and r["account_id"] is not None
        if named and any(o["row_id"] < i and content(o) == content(r) for o in rows
                         if o["location_id"] is not None and o["account_id"] is not None):
            found.add((i, "D-001"))
        if r["latitude"] is not None and r["longitude"] is not None:
            here = [o for o in rows if (nan(o["latitude"]), o["longitude"]) == (nan(r["latitude"]), r["longitude"])]
            if r["location_id"] is not None and len({o["location_id"] for o in here} - {None}) > 1:
                found.add((i, "D-002"))
            level = lambda o: (o["geocode_level"] or "").strip().lower() == "postcode"
            if level(r) and sum(map(level, here)) >= 10:
                found.add((i, "G-005"))
        if r["location_id"] is not None and any(
                o["tiv_building"] != r["tiv_building"] for o in rows if o["location_id"] == r["location_id"]):
            found.add((i, "D-004"))
        if t is not None and 0 < t < 1e23 and abs(t - round(t / 1e6) * 1e6) < 1 \
                and sum(rounded(o) == rounded(r) for o in rows) >= 10:
            found.add((i, "P-002"))
    return found


@pytest.mark.parametrize(("max_rows", "hot_rows"), [(None, 10**9), (0, 10**9), (0, 20), (0, 0)])
def test_group_rules_equal_all_pairs(spark, max_rows, hot_rows):
    df = portfolio(spark)
    got = detect.group_flags(df, max_rows=max_rows, hot_rows=hot_rows).collect()
    want = by_pairs(df.collect())
    assert len(got) == len(want) and {(r["row_id"], r["rule_id"]) for r in got} == want
    assert {rule for _, rule in want} == detect.GROUP_RULES


def test_only_some_group_rules(spark):
    df = portfolio(spark, 120)
    every = {(r["row_id"], r["rule_id"]) for r in detect.group_flags(df).collect()}
    for only in ({"D-001"}, {"G-005"}, {"D-004", "P-002"}):
        got = {(r["row_id"], r["rule_id"]) for r in detect.group_flags(df, only).collect()}
        assert got == {x for x in every if x[1] in only}
    assert detect.group_flags(df.limit(0)).count() == 0


def operators(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan", plan)), len(re.findall(r"Exchange hashpartitioning", plan))


def test_detection_reads_the_portfolio_a_few_times(spark):
    # the thresholds and totals are jobs of their own, the groups are stored by the first of two passes
    scans, shuffles = operators(QUERIES["d40_detect_all"](spark, SF_DIR))
    assert scans <= 10 and shuffles <= 6, (scans, shuffles)
    scans, shuffles = operators(QUERIES["d22_d001_exact_row_duplicate"](spark, SF_DIR))
    assert scans <= 4 and shuffles <= 4, (scans, shuffles)


def test_group_pass_is_one_scan_and_one_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detect, "materialise", lambda df, name: seen.append(df) or df)
    detect.shared_groups(workspace(spark, SF_DIR).portfolio, {0, 1, 2, 3})
    assert operators(seen[0]) == (1, 1)
    assert seen[0].filter(F.col("hot")).count() == 0
