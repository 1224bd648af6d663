"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

RING = T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)

# Partition of stored observations: year and month of ``ts``.
MONTH = "month"
# Partition by place: a number along a space-filling curve.
AREA = "area"

OBSERVATIONS = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("band", T.StringType()),
        T.StructField("tile_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)

GRID = T.StructType(
    [
        T.StructField("tile_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        *[
            T.StructField(name, T.FloatType())
            for name in ("prefire_nbr", "postfire_nbr", "dnbr", "rdnbr", "rbr")
        ],
        T.StructField("fire_event_name", T.StringType()),
        T.StructField("job_id", T.StringType()),
    ]
)

ZONES = T.StructType(
    [
        T.StructField("zone_id", T.LongType()),
        T.StructField("veg_type", T.StringType()),
        T.StructField("rings", T.ArrayType(RING)),
        T.StructField("minx", T.DoubleType()),
        T.StructField("miny", T.DoubleType()),
        T.StructField("maxx", T.DoubleType()),
        T.StructField("maxy", T.DoubleType()),
    ]
)

ASSET = T.StructType(
    [
        T.StructField("href", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
    ]
)

LINK = T.StructType(
    [
        T.StructField("rel", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fire_event_name", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("boundary_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("minx", T.DoubleType()),
        T.StructField("miny", T.DoubleType()),
        T.StructField("maxx", T.DoubleType()),
        T.StructField("maxy", T.DoubleType()),
        T.StructField("assets", T.MapType(T.StringType(), ASSET)),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("fire_event_name", T.StringType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("prefire_start", T.StringType()),
        T.StructField("prefire_end", T.StringType()),
        T.StructField("postfire_start", T.StringType()),
        T.StructField("postfire_end", T.StringType()),
    ]
)
