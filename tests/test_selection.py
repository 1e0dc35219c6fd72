"""Selection of errors against a plain loop over the records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tivlens.operators import corrupt

ROWS = 6000


def clean_rows(spark):
    k = F.col("k")
    return spark.range(ROWS).withColumnRenamed("id", "k").select(
        # some ids are missing, some repeat
        F.when(k % 500 != 7, F.when(k % 100 == 3, k - 1).otherwise(k)).alias("row_id"),
        F.lit(20.5).alias("latitude"), F.when(k % 9 != 0, 85.5).alias("longitude"), F.lit(5.0).alias("tiv_building"),
        F.lit(9.0).alias("tiv_total"), F.lit("700001").alias("postcode"), F.lit("A").alias("district"), F.lit("Aton").alias("city"),
        F.when(k % 3 == 0, "ind").otherwise("res").alias("occupancy_code"), F.lit(3).alias("num_storeys"),
        F.lit("L").alias("location_id"), F.lit("1 Main Road").alias("address_line"))


def by_loop(rows):
    """Masks per row in order: per type the records that may get it, smallest digests first."""
    located = [r["latitude"] is not None and r["longitude"] is not None for r in rows]
    may = {"X7": located, "G2": located, "G5": located, "D2": located,
           "P5": [r["occupancy_code"] == "ind" for r in rows]}
    masks, counts = [0] * len(rows), corrupt.targets(len(rows))
    for t in corrupt.TYPES:
        blockers = sum(1 << corrupt.BIT[b.name] for b in corrupt._blockers(t))
        ids = ["" if r["row_id"] is None else str(r["row_id"]) for r in rows]
        u = {i: hashlib.md5(f"{corrupt.SEED}|{t.name}|{ids[i]}".encode()).hexdigest() for i, m in enumerate(masks)
             if may.get(t.name.split("_")[0], [True] * len(rows))[i] and not m & blockers}
        n = counts[t.name]
        cut = "" if n == 0 else sorted(u.values())[n - 1] if n <= len(u) else "g"
        for i, x in u.items():
            masks[i] |= (x <= cut) << corrupt.BIT[t.name]
    return sorted((-1 if r["row_id"] is None else r["row_id"], m) for r, m in zip(rows, masks, strict=True))


@pytest.mark.parametrize("wrong", [False, True])
def test_selection_equals_loop_and_ranks_few_digests(spark, monkeypatch, wrong):
    given, plain = [], corrupt.cutoffs

    def watched(candidates, wanted, *more):
        given.append(candidates.count())
        return plain(candidates, wanted, *more)

    monkeypatch.setattr(corrupt, "cutoffs", watched)
    if wrong:  # intervals that miss the cutoff must not change the result
        monkeypatch.setattr(corrupt, "_interval", lambda wanted, candidates: ("8", "8") if wanted % 2 else ("", "0000"))
    clean = clean_rows(spark)
    found = sorted((-1 if r["row_id"] is None else r["row_id"], r["__mask"])
                   for r in corrupt.select_errors(clean).select("row_id", "__mask").collect())
    assert found == by_loop(clean.collect())
    if not wrong:  # before, all 38 types ranked all records that may get them
        assert sum(given) < 10 * ROWS
