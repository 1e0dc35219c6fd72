"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tivlens-llm-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/tivlens-{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, independent of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; everything else stays."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


SENT_KEYS = 2_000_000


def matching(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", most: int = SENT_KEYS) -> DataFrame:
    """``rows`` whose key is (``left_semi``) or isn't (``left_anti``) among ``keys``, one column of distinct numbers.

    Up to ``most`` keys are counted and sent to the tasks, so that wide rows stay where they are; more are
    joined with a shuffle.
    """
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, key, how)
