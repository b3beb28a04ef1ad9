"""Region layers from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.operators.grids import stop_unless

# Coordinates stay text until the geometry type says how deep they nest.
COLLECTION_SCHEMA = """
type STRING,
features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>
"""


def read_regions(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    columns: tuple[str, ...] = (),
    id_column: str = "region_id",
    multi_line: bool = True,
    select_one: bool = False,
) -> DataFrame:
    """Features as ``region_id, ord, <columns>, rings``; absent columns read ''.

    ``name`` selects features by their ``name`` property. With ``select_one``
    the result must be exactly one region, else the query stops.
    """
    documents = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", multi_line).json(path)
    features = documents.select(F.posexplode("features").alias("ord", "f"))
    polygon = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    multi = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(multi)).otherwise(polygon)
    points = F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    )
    properties = F.col("f.properties")

    def attribute(key: str):
        return F.coalesce(F.try_element_at(properties, F.lit(key)), F.lit(""))

    chosen = features if name is None else features.where(attribute("name") == name)
    table = chosen.select(
        F.coalesce(F.try_element_at(properties, F.lit(id_column)), attribute("name")).alias("region_id"),
        "ord",
        *[attribute(c).alias(c) for c in columns],
        points.alias("rings"),
    )
    if not select_one:
        return table
    count = table.agg(F.count("*").alias("n"))
    one = count.where(stop_unless(F.col("n") == 1, "expected exactly one region")).scalar()
    return table.where(one == 1)


def to_geojson(regions: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """One FeatureCollection line per region, column ``value``."""
    shape = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    properties = F.struct(*[F.col(c).cast("string").alias(c) for c in ("region_id", *columns)])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        properties.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), shape.alias("coordinates")).alias("geometry"),
    )
    document = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    return regions.select(F.to_json(document).alias("value"))
