"""The derived portfolio at keys of any size."""

from tivlens.sources import derived


def test_copies_get_ids_of_their_own(spark, tmp_path):
    keys = [10_000_905 + k for k in range(8)] + [905 + k for k in range(8)] + [20_000_908]
    orders = spark.createDataFrame([(k, k % 7) for k in keys], "o_orderkey long, o_custkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    marked = derived.marked_portfolio(spark, str(tmp_path)).select("row_id", "location_id", "m").collect()
    copies = [r for r in marked if r.m >= 1000]
    assert len({r.row_id for r in marked}) == len(marked) == len(keys) + 9
    assert len(copies) == 9 and {r.m % 1000 for r in copies} == {906, 907, 908, 909}
    assert min(r.row_id for r in copies) > max(r.row_id for r in marked if r.m < 1000)
    truth = {r.row_id for r in derived.ground_truth_of(derived.marked_portfolio(spark, str(tmp_path))).collect()
             if r.error_type.startswith("D1")}
    assert truth == {r.row_id for r in copies}
    clean = {r.row_id for r in derived.clean_baseline(spark, str(tmp_path)).collect()}
    assert clean == {r.row_id for r in marked if 910 <= r.m < 1000}
