"""Line dedup: lines that several documents share stay in one document only.

Normalised lines are exploded and hashed, the distinct documents of each hash are
counted, and lines whose hash reaches the threshold are dropped everywhere but in
the document with the smallest id. What is left is put together by position.

Only narrow rows (16-byte hash, id, position) are shuffled by hash, pre-aggregated;
the join back is an ordinary shuffle join whose hot hashes Spark splits at run time.
Each document's lines are shuffled once, by id.

Defined cases: a null or empty text is one empty line; keys are compared by MD5; rows
without an id neither share nor lose lines; rows that repeat an id are one document
when documents are counted, and each of them loses the lines that document loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tivlens.llm.common import SPACES, lower_ascii, stored


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``kept_text``, ``n_lines``, ``n_dropped``.

    With ``carry``, column ``row`` holds the other columns of ``docs`` as a struct.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    base = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.split(text, "\n").alias("parts"),
        *([F.struct(*others).alias("row")] if carry else []))
    key = lower_ascii(F.trim(F.col("line"), F.lit(SPACES)))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"),
                F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("doc", "version", "pos", key.alias("key")).where(F.length("key") >= min_chars)
        .select("doc", "version", "pos", F.unhex(F.md5("key")).alias("hash")))
    shared = (
        lines.select("hash", "doc").distinct().groupBy("hash")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("hash", "keeper"))
    shared = stored(shared, "shared_lines")  # a plain table, so that Spark can split hot hashes in the join
    drops = (
        lines.join(shared, "hash").where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias("d"), F.col("version").alias("v")).agg(F.collect_set("pos").alias("drops")))
    placed = base.join(drops, (F.col("doc") == F.col("d")) & (F.col("version") == F.col("v")), "left")
    # parts comes from below the join, so the lambda only looks up array elements
    every = F.sequence(F.lit(0), F.size("parts") - 1)
    left = F.transform(F.array_except(every, "drops"), lambda i: F.get("parts", i))
    return placed.select(
        F.col("doc").alias("doc_id"),
        F.array_join(F.when(F.col("drops").isNull(), F.col("parts")).otherwise(left), "\n").alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        *(["row"] if carry else []))
