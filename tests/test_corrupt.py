"""Selection and donors of the corruption job against their definitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tivlens.operators import corrupt
from tivlens.registry.workspace import workspace

SF_DIR = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def w(spark):
    return workspace(spark, SF_DIR)


@pytest.mark.parametrize(("digits", "leaf"), [(4, 100_000), (1, 100_000), (1, 3), (1, 1), (2, 5)])
def test_cutoffs_at_any_depth(spark, monkeypatch, digits, leaf):
    monkeypatch.setattr(corrupt, "PREFIX_DIGITS", digits)
    monkeypatch.setattr(corrupt, "LEAF", leaf)
    values = {"a": [md5(f"a{i}") for i in range(700)], "b": [md5(f"b{i}") for i in range(40)], "c": [md5("c")], "d": []}
    # digests that share a long prefix
    values["b"] += ["0" * 31 + x for x in "0123456789"]
    df = spark.createDataFrame([(k, u) for k, us in values.items() for u in us], "label string, u string")
    wanted = {"a": 333, "b": 4, "c": 1, "d": 2}
    got = corrupt.cutoffs(df, wanted)
    assert got == {k: sorted(us)[wanted[k] - 1] if len(us) >= wanted[k] else "g" for k, us in values.items()}
    assert corrupt.cutoffs(df, {"a": 0, "b": 51}) == {"a": "", "b": "g"}


def test_selection_writes_the_portfolio_once(w, monkeypatch):
    written = []
    monkeypatch.setattr(corrupt, "materialise", lambda df, name, f=corrupt.materialise: written.append(df.columns) or f(df, name))
    marked = corrupt.select_errors(w.pristine)
    wide = [c for c in written if len(c) > 3]
    assert len(wide) == 1 and len(written) == len(corrupt.levels()) + 2
    # the masks of the narrow steps and of the pass over the whole rows agree with the stored selection
    assert marked.select("row_id", "__mask").exceptAll(w.selected.select("row_id", "__mask")).count() == 0


def _marked(spark, n, receivers):
    bit = 1 << corrupt.BIT[corrupt.SHORT["D4"]]
    return spark.createDataFrame(
        [(i, f"L{i % 17}", bit if i in receivers else 0) for i in range(n)], "row_id long, location_id string, __mask long")


@pytest.mark.parametrize("n", [1, 2, 60, 97, 1000])
def test_donor_is_the_smallest_combined_digest_of_the_block(spark, n):
    receivers = set(range(0, n, 9)) if n > 1 else {0}
    got = {r["row_id"]: r["given"]["location_id"] if r["given"] else None for r in corrupt.borrow(
        _marked(spark, n, receivers), "D4", ["location_id"], F.lit(True)).collect()}
    donors = {i: md5(f"42|D4-donor|{i}") for i in range(n) if i not in receivers}
    blocks = 1
    while blocks * 2 <= len(donors) // corrupt.DONORS_PER_BLOCK:
        blocks *= 2
    block = lambda u: int(u[:8], 16) % blocks
    want = {}
    for i in receivers:
        u = md5(f"42|D4-receiver|{i}")
        here = [d for d, du in donors.items() if block(du) == block(u)]
        donor = min(here, key=lambda d: md5(u + donors[d])) if here else min(donors, key=donors.get, default=None)
        want[i] = None if donor is None else f"L{donor % 17}"
    assert got == want


def test_blocks_without_donors_use_the_spare(spark, monkeypatch):
    monkeypatch.setattr(corrupt, "DONORS_PER_BLOCK", 1)
    receivers = set(range(0, 200, 2))
    got = corrupt.borrow(_marked(spark, 200, receivers), "D4", ["location_id"], F.lit(True)).collect()
    spare = min((i for i in range(200) if i not in receivers), key=lambda i: md5(f"42|D4-donor|{i}"))
    assert len(got) == 100 and all(r["given"] for r in got)
    assert sum(r["given"]["location_id"] == f"L{spare % 17}" for r in got) > 10  # about a third of the blocks are empty


def test_without_donors_fields_stay(spark, w):
    # every record is a receiver of D4, so nobody can lend
    bit = 1 << corrupt.BIT[corrupt.SHORT["D4"]]
    rows = w.pristine.limit(20).withColumn("__mask", F.lit(bit).cast("long"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    dirty = {r["row_id"]: r["location_id"] for r in corrupt.apply_errors(rows, w.places).collect()}
    assert dirty == {r["row_id"]: r["location_id"] for r in rows.collect()}


def test_pristine_portfolio_is_clean(w):
    assert w.pristine.count() == w.pristine.select("row_id").distinct().count()
    assert w.pristine.filter("latitude IS NULL OR tiv_total <= 0 OR year_built IS NULL OR currency <> 'INR'").count() == 0


def test_the_portfolio_is_never_broadcast(spark, tmp_path, monkeypatch):
    """Neither donors nor the rows before and after, though their files are far below the threshold."""
    rows = spark.range(1, 400).select(
        F.col("id").alias("row_id"), F.lit("A").alias("location_id"), (F.col("id") % 3 * (1 << corrupt.BIT[corrupt.SHORT["D4"]])).alias("__mask"),
        *[F.lit(None).cast("string").alias(c) for c in sorted({f for t in corrupt.TYPES for f in t.shown or t.fields} - {"location_id"})])
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows").filter("row_id % 3 < 2")
    copies = rows.filter("row_id < 5").withColumn("source_row_id", F.col("row_id")).withColumn("row_id", F.col("row_id") + 1000)
    for df in (corrupt.borrow(rows, "D4", ["location_id"], F.lit(True)), corrupt.ground_truth(rows.drop("__mask"), rows, copies)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_copies_inherit_the_events_of_each_row_with_their_source_id(spark):
    mask = 1 << corrupt.BIT[corrupt.SHORT["D3"]]
    fields = sorted({f for t in corrupt.TYPES for f in t.shown or t.fields})
    clean = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "row_id long, address_line string").select(
        "row_id", *["address_line" if f == "address_line" else F.lit(None).cast("string").alias(f) for f in fields])
    dirty = clean.filter("address_line <> 'y'").withColumn("__mask", F.lit(mask).cast("long"))
    copies = spark.createDataFrame([(11, 1), (12, 1), (13, None)], "row_id long, source_row_id long")
    found = corrupt.ground_truth(clean, dirty, copies).groupBy("error_type", "row_id").count().collect()
    got = {(r["error_type"][:2], r["row_id"]): r["count"] for r in found}
    assert got == {("D3", 1): 2, ("D3", 11): 2, ("D3", 12): 2, ("D3", 2): 1, ("D1", 11): 1, ("D1", 12): 1, ("D1", 13): 1}
