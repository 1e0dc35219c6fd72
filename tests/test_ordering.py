import random
import statistics

from pyspark.sql import Window as W, functions as F

from tivlens.operators import groups, ordering, sizing
from tivlens.operators.materiality import percentiles


def test_median_odd_even_ties(spark):
    rnd = random.Random(1)
    for values in ([3.0], [1.0, 2.0], [5.0] * 10 + [1.0], [rnd.uniform(0, 9) for _ in range(501)],
                   [float(rnd.randrange(5)) for _ in range(400)]):
        df = spark.createDataFrame([(v,) for v in values + [None]], "v double")
        row = ordering.exact_median(df, "v", buckets=7).first()
        assert row["median"] == statistics.median(values) and row["maximum"] == max(values)


def test_percentiles_match_window(spark):
    rnd = random.Random(2)
    values = [rnd.choice([None, 7.0, float(rnd.randrange(50))]) for _ in range(999)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, materiality_tiv double")
    w = W.orderBy(F.col("materiality_tiv").asc_nulls_last())
    plain = df.withColumn("tiv_percentile", F.when(
        F.col("materiality_tiv").isNotNull(), F.round(F.percent_rank().over(w) * 100, 2)))
    for buckets in (1, 5, 64):
        got = percentiles(df, buckets)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == \
            sorted(map(tuple, plain.collect()), key=lambda r: r[0])


def test_percentile_of_one_row(spark):
    df = spark.createDataFrame([(1, 5.0)], "row_id long, materiality_tiv double")
    assert percentiles(df).first()["tiv_percentile"] == 0.0


def test_row_numbers_are_dense(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    got = {r["k"]: r["row_id"] for r in ordering.row_numbers(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(range(0, 3000, 3))}


def test_group_join_with_hot_key(spark):
    """A third of all rows on one key: same result through the broadcast and the shuffle part."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    stats = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    plain = sorted(map(tuple, rows.join(stats, "k").collect()))
    small = [r for r in plain if r[2] == 1]
    for hot in (0, 10, 10**9):
        got = groups.join_groups(rows, stats, ["k"], "n", hot_rows=hot)
        assert sorted(map(tuple, got.collect())) == plain
        got = groups.join_groups(rows, stats, ["k"], "n", F.col("n") == 1, hot)
        assert sorted(map(tuple, got.collect())) == small


def test_salted_join_equals_join(spark):
    facts = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
    ref = spark.createDataFrame([(1, "a"), (450, "b")], "k long, v string")
    for how in ("left", "inner"):
        a = sorted(map(str, facts.join(ref, "k", how).select("id", "k", "v").collect()))
        b = sorted(map(str, sizing.salted_join(facts, ref, ["k"], how, 7).select("id", "k", "v").collect()))
        assert a == b
        c = sizing.lookup_join(facts, ref, ["k"], how, max_rows=1).select("id", "k", "v")
        assert sorted(map(str, c.collect())) == a
