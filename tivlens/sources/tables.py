"""Tables in and out: explicit schemas, idempotent writes, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


#: What a scan adds with ``errors="keep"``: fields that hold something else than their type, and lines that are no record.
MALFORMED = T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())]))


class MalformedInput(ValueError):
    """A file holds values that are not of their column's type, or lines with missing or surplus fields."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType, errors: str = "keep_quiet") -> DataFrame:
    """CSV with a header. The schema is given, so identifiers stay text and no pass infers types.

    A field that doesn't parse becomes NULL. With ``errors="keep"`` the rows get ``malformed``, the names and
    texts of such fields, and ``bad_record``, the text of a line with missing or surplus fields; with
    ``errors="fail"`` one pass counts both and raises ``MalformedInput`` if there are any.
    """
    if errors == "keep_quiet":
        return spark.read.schema(schema).option("header", True).csv(path)
    typed = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    as_text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema], T.StructField("bad_record", T.StringType())])
    # without pruning: whether a line is a record shows only when all its fields are split
    rows = spark.read.schema(as_text).options(
        header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record", columnPruning=False).csv(path)
    parsed = {f.name: F.trim(f.name).try_cast(f.dataType) for f in typed}
    wrong = F.filter(F.array(*[
        F.when(F.col(n).isNotNull() & v.isNull(), F.struct(F.lit(n).alias("field"), F.col(n).alias("value")))
        for n, v in parsed.items()]), lambda x: x.isNotNull())
    out = rows.select(
        *[parsed[f.name].alias(f.name) if f.name in parsed else F.col(f.name) for f in schema],
        (wrong if typed else F.array()).cast(MALFORMED).alias("malformed"), "bad_record")
    if errors == "keep":
        return out
    lost = out.agg(F.sum(F.size("malformed")).alias("fields"), F.count("bad_record").alias("lines")).first()
    if lost["fields"] or lost["lines"]:
        raise MalformedInput(f"{path}: {lost['fields'] or 0} fields and {lost['lines']} lines don't fit the schema")
    return out.drop("malformed", "bad_record")


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Parquet table; ``overwrite`` rebuilds it, ``append`` adds to it."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def store_bucketed(
    df: DataFrame, path: str, key: str = "row_id", buckets: int | None = None
) -> DataFrame:
    """Store ``df`` at ``path`` in buckets of ``key``, each one sorted file, and read it back as a table.

    Joins and groupings on the key then need no exchange, with other such tables and with the results of
    shuffles alike: there are as many buckets as shuffle partitions. The files are plain Parquet; the
    table's entry in the catalog, which knows of the buckets, lasts as long as the session's catalog does.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tivlens_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format(
        "parquet").saveAsTable(name)
    return spark.table(name)


def replace_keyed(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows whose key occurs in ``new`` replaced by the rows of ``new``."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def store_keyed(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Store ``df`` in ``parts`` folders by a hash of its key, for ``replace_in_place``."""
    df.withColumn("part", _part(key, parts)).repartition(parts, "part").write.partitionBy("part").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def replace_in_place(spark: SparkSession, path: str, new: DataFrame, key: str, parts: int) -> None:
    """``replace_keyed`` on a stored table: only the folders that ``new`` has keys for are read and written again.

    The merged folders are stored first, so a lost executor never leaves a folder without its rows.
    """
    touched = [r[0] for r in new.select(_part(key, parts)).distinct().collect()]  # at most ``parts``
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("part").isin(touched)).drop("part")
    merged = materialise(replace_keyed(old, new.select(old.columns), key).withColumn("part", _part(key, parts)), "merged")
    merged.repartition(len(touched), "part").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_text(report: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Lines ``(position, line)`` as one text file in order (a report, a handful of lines)."""
    report.coalesce(1).sortWithinPartitions("position").select("line").write.mode(mode).text(path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", "")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tivlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives executor loss.

    With ``key`` it is stored in buckets of it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if key:
        return store_bucketed(df, path, key)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_codes(df: DataFrame, column: str, names: dict[str, str], target: str) -> DataFrame:
    """Keep the rows whose code is mapped and add its name."""
    mapped = F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in names.items()])
    return df.withColumn(target, mapped).filter(F.col(target).isNotNull())
