import numpy as np
import pytest
from pyspark.sql import functions as F

from tivlens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, rank string"


def brute(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in good:
        if q % 5 == 0:
            s = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def search(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x[600:900] = x[600] + rng.standard_normal((300, 16)) * 0.01  # near copies
    x[900:950] = x[900]  # exact copies
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])


def test_recall_and_exact_scores(spark, vectors):
    got, want = search(spark, vectors), brute(vectors, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    assert recall(got, want) >= 0.9
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors}
    assert all(abs(s - (good[q] * good[i]).sum()) < 1e-12 for q, r in got.items() for i, s in r)


def test_recall_in_small_blocks(spark, vectors, monkeypatch):
    for name, value in (("GROUP", 64), ("BLOCK_QUERIES", 16), ("BATCH", 100)):
        monkeypatch.setattr(ann, name, value)
    got, want = search(spark, vectors), brute(vectors, 20)
    assert all(len(r) == 20 for r in got.values()) and recall(got, want) >= 0.9


def test_a_table_of_2000_rows_is_not_searched_whole(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.standard_normal((2000, 32))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    seen, plain = [], ann.visits_of

    def visits_of(asked, runs, *rest):
        visits = plain(asked, runs, *rest).persist()
        reached = visits.join(runs, ["tree", "level", "prefix"]).groupBy("id").agg(F.sum("rows").alias("rows"))
        seen.extend([visits.agg(F.min("level")).first()[0], reached.agg(F.avg("rows")).first()[0]])
        return visits

    monkeypatch.setattr(ann, "visits_of", visits_of)
    got, want = search(spark, rows), brute(rows, 20)
    assert recall(got, want) >= 0.9
    assert seen[0] > 0 and seen[1] < 2000  # of 16,000: rows met in all trees, repeats included


def test_what_grows_with_the_input_is_not_broadcast(spark, vectors, monkeypatch):
    plans, plain = {}, ann.stored

    def stored(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(ann, "stored", stored)
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in vectors[:600]], SCHEMA)
    last = ann.nearest(df, F.col("vec_id") % 5 == 0)._jdf.queryExecution().executedPlan().toString()
    joins = [line for plan in plans["waiting"] for line in plan.splitlines() if "Join" in line]
    # the loop's tables are probed and written, so each of its plans has all its joins
    assert len(joins) >= 4 and all("SortMergeJoin" in line for line in joins)
    # in the last one only the cuts of blocks are sent, on both sides
    assert [line.count("[tree") for line in last.splitlines() if "BroadcastHashJoin" in line] == [2, 2]
    assert "SortMergeJoin [id" in last


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (10, [0.0, 0.0]), (15, [nan, 1.0]), (20, [inf, 1.0]),
            (25, [1.0, None]), (30, [1.0, 2.0, 3.0]), (35, []), (3, [-1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]
    assert search(spark, rows) == {0: [(1, 1.0), (2, 1.0), (3, -1.0)]}
    assert search(spark, rows, k=1) == {0: [(1, 1.0)]}
    assert search(spark, []) == {} and search(spark, [(0, None)]) == {}


def test_repeated_ids_count_once(spark, vectors):
    rows = vectors[:300]
    ids = {q: [i for i, _ in r] for q, r in search(spark, rows).items()}
    assert {q: [i for i, _ in r] for q, r in search(spark, rows * 2).items()} == ids
    # one id many times with vectors of its own, all nearer than those of other ids
    best = (10_001, [100 * c for c in rows[0][1]])
    near = [(10_001, [(100 - k / 100) * c for c in rows[0][1]]) for k in range(1, 60)]
    got = search(spark, [*rows, *near, *[best] * 30])[0]
    others, order = [i for i, _ in got[1:]], [i for i, _ in brute(rows, 299)[0]]
    assert got[0][0] == 10_001 and len(set(others)) == 19 and sorted(others, key=order.index) == others
    assert len(set(others) & set(order[:19])) >= 17
    assert abs(got[0][1] - (np.array(best[1], np.float32).astype(float) * np.array(rows[0][1], np.float32)).sum()) < 1e-9
