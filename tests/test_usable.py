"""What is stored between cleansing and placing."""

from pyspark.sql import functions as F

from tivlens.registry.workspace import workspace


def test_usable_records_are_stored_without_the_columns_that_nothing_reads(spark):
    w = workspace(spark, "/root/testdata/sf0.001")
    assert len(w.usable.columns) < 12 < len(w.cleansed.columns)
    assert w.usable.count() == w.cleansed.filter(~F.col("quarantined")).count()
