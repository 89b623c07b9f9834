"""Zones as GeoJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type string, features array<struct<type: string, properties: struct<id: string, label: string, kind: string, description: string, visible: boolean, decorative: boolean>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Zones of the polygon features of a collection; features without an id are left out."""
    f = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    return f.where("geometry.type = 'Polygon' AND properties.id IS NOT NULL").select("properties.*", F.col("geometry.coordinates").alias("rings"))


def write(zones: DataFrame, path: str) -> None:
    """Zones as one feature per line."""
    about = F.struct(*(c for c in zones.columns if c != "rings"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    zones.select(F.to_json(F.struct(F.lit("Feature").alias("type"), about.alias("properties"), shape.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)
