"""Boundaries from GeoJSON as an edge table ``(poly_id, x1, y1, x2, y2)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_POINT = T.ArrayType(T.DoubleType())
_RING = T.ArrayType(_POINT)
_POLYGON = T.ArrayType(_RING)
_MULTI = T.ArrayType(_POLYGON)


_PROPERTIES = T.MapType(T.StringType(), T.StringType())
# the nesting depth of coordinates depends on the type, so they are read as text first
_GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE = T.StructType([
    T.StructField("properties", _PROPERTIES), T.StructField("geometry", _GEOMETRY)])

#: Writers begin every feature with its type; what stands between two such marks is one feature.
_MARK = '"Feature"'
_OPENED = r'\{\s*"type"\s*:\s*$'
_NEXT = r'\}\s*,\s*\{\s*"type"\s*:\s*$'


def split_features(spark: SparkSession, path: str) -> DataFrame | None:
    """``(feature)`` with a row per feature, read by several tasks, or None if the file isn't written that way.

    The text is cut at the type that every feature begins with, wherever lines end. Each piece is the
    rest of a feature and the beginning of the next one; its first JSON value is the feature, if it is whole.
    """
    pieces = spark.read.option("lineSep", _MARK).text(path)
    value = F.col("value")
    head = value.rlike(r'^\s*\{') & value.rlike(_OPENED)
    features = pieces.filter(value.rlike(r"^\s*,")).select(
        (value.rlike(_NEXT) | ~value.rlike(_OPENED)).alias("closed"),
        F.from_json(F.concat(F.lit('{"type":""'), value), _FEATURE).alias("feature"))
    pieces_ok = pieces.agg(F.count("*").alias("n"), F.count_if(head).alias("heads")).first()
    found = features.agg(F.count_if(F.col("closed") & F.col("feature.geometry").isNotNull()).alias("n")).first()
    files = len(pieces.inputFiles())
    whole = pieces_ok["heads"] == files and found["n"] == pieces_ok["n"] - files and found["n"] > 0
    return features.select("feature") if whole else None


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """The same from one JSON value: any layout, in one task."""
    schema = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("feature"))


def read_boundaries(
    spark: SparkSession,
    path: str,
    id_property: str,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Polygons and multipolygons of a FeatureCollection in degrees (EPSG:4326).

    ``names`` renames the wanted ids and drops all other features.
    """
    features = split_features(spark, path)
    if features is None:
        features = _whole_file(spark, path)
    features = features.select(
        F.element_at("feature.properties", F.lit(id_property)).alias("poly_id"),
        F.col("feature.geometry.type").alias("type"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
    )
    if names is not None:
        wanted = F.coalesce(*[F.when(F.col("poly_id") == k, F.lit(v)) for k, v in names.items()])
        features = features.withColumn("poly_id", wanted).filter(F.col("poly_id").isNotNull())
    polygons = F.when(
        F.col("type") == "MultiPolygon", F.from_json("coordinates", _MULTI)
    ).when(
        F.col("type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON))
    )
    rings = features.select("poly_id", F.explode(F.flatten(polygons)).alias("ring"))
    pairs = rings.select("poly_id", F.explode(F.arrays_zip(
        F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"),
        F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"),
    )).alias("e"))
    return pairs.select(
        "poly_id",
        F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
    )
