"""GeoJSON texts to rings and back, with a reason for every rejected text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.constants import STAC_VERSION
from charscape.functions.staging import stage
from charscape.functions.timeparse import utc_text

# Reasons in the order they are tested.
MALFORMED = "malformed json"
NOT_POLYGON = "not a polygon"
NO_COORDINATES = "no coordinates"
SHORT_POSITION = "position without x and y"
SHORT_RING = "ring of fewer than four points"
OPEN_RING = "ring not closed"

_COORDINATES = "array<array<array<double>>>"
_PARTS = f"array<{_COORDINATES}>"


def parse_polygons(df: DataFrame, text: str = "text", parts: bool = False) -> DataFrame:
    """Adds ``rings``, and ``reason`` where the text holds no valid polygon.

    Accepted are a Polygon, bare, in a Feature, or in the first feature of a collection; with
    ``parts`` also a MultiPolygon, whose rings follow each other.
    """
    document = F.col("_document")
    nested = F.coalesce(
        F.try_variant_get(document, "$.geometry", "variant"),
        F.try_variant_get(document, "$.features[0].geometry", "variant"),
        document,
    )
    coordinates = F.col("_coordinates")
    kinds = ("Polygon", "MultiPolygon") if parts else ("Polygon",)
    flat = F.flatten(F.try_variant_get("_shape", "$.coordinates", _PARTS))
    single = F.try_variant_get("_shape", "$.coordinates", _COORDINATES)

    def any_ring(test) -> Column:
        return F.exists(coordinates, test)

    def without_xy(position: Column) -> Column:
        return F.get(position, F.lit(0)).isNull() | F.get(position, F.lit(1)).isNull()

    def first_differs_from_last(ring: Column) -> Column:
        first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
        return (F.get(first, F.lit(0)) != F.get(last, F.lit(0))) | (
            F.get(first, F.lit(1)) != F.get(last, F.lit(1))
        )

    def point(position: Column) -> Column:
        return F.struct(
            F.get(position, F.lit(0)).alias("x"), F.get(position, F.lit(1)).alias("y")
        )

    reason = (
        F.when(document.isNull(), F.lit(MALFORMED))
        .when(~F.coalesce(F.col("_kind").isin(*kinds), F.lit(False)), F.lit(NOT_POLYGON))
        .when(coordinates.isNull() | (F.size(coordinates) == 0), F.lit(NO_COORDINATES))
        .when(any_ring(lambda r: F.size(r) < 4), F.lit(SHORT_RING))
        .when(any_ring(lambda r: F.exists(r, without_xy)), F.lit(SHORT_POSITION))
        .when(any_ring(first_differs_from_last), F.lit(OPEN_RING))
    )
    rings = F.transform(coordinates, lambda ring: F.transform(ring, point))
    parsed = stage(df, {"_document": F.try_parse_json(F.col(text))})
    parsed = stage(parsed, {"_shape": nested})
    parsed = stage(parsed, {"_kind": F.try_variant_get("_shape", "$.type", "string")})
    found = F.when(F.col("_kind") == "MultiPolygon", flat).otherwise(single) if parts else single
    parsed = stage(parsed, {"_coordinates": found})
    parsed = stage(parsed, {"reason": reason})
    parsed = stage(parsed, {"rings": F.when(F.col("reason").isNull(), rings)})
    return parsed.drop("_document", "_shape", "_kind", "_coordinates")


def polygon_struct(rings: Column) -> Column:
    return F.struct(
        F.lit("Polygon").alias("type"),
        F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias(
            "coordinates"
        ),
    )


def polygon_text(rings: Column) -> Column:
    return F.to_json(polygon_struct(rings))


def box_text(bounds: dict[str, Column]) -> Column:
    """The rectangle of a bounding box as a Polygon."""
    corners = (
        ("minx", "miny"),
        ("maxx", "miny"),
        ("maxx", "maxy"),
        ("minx", "maxy"),
        ("minx", "miny"),
    )
    ring = F.array(*[F.array(bounds[x], bounds[y]) for x, y in corners])
    return F.to_json(
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    )


def feature_struct(rings: Column, properties: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        polygon_struct(rings).alias("geometry"),
        properties.alias("properties"),
    )


def feature_text(rings: Column, properties: Column) -> Column:
    return F.to_json(feature_struct(rings, properties))


def created_properties(created: Column) -> Column:
    """Properties of a feature that was given none."""
    return F.struct(created.alias("created"))


def collection_text(
    rings: Column, properties: Column, extra: dict[str, Column] | None = None
) -> Column:
    """A collection of one feature, with further keys on the collection itself."""
    return F.to_json(
        F.struct(
            F.lit("FeatureCollection").alias("type"),
            F.array(feature_struct(rings, properties)).alias("features"),
            *[column.alias(name) for name, column in (extra or {}).items()],
        )
    )


def item_feature_text(item_columns: set[str]) -> Column:
    """One catalogue item as a Feature document."""
    optional = [
        F.col(name)
        for name in ("title", "description", "boundary_type")
        if name in item_columns
    ]
    properties = F.struct(
        utc_text(F.col("datetime")).alias("datetime"),
        "fire_event_name",
        "job_id",
        "product_type",
        *optional,
    )
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.lit(STAC_VERSION).alias("stac_version"),
            F.col("id"),
            properties.alias("properties"),
            F.try_parse_json("geometry").alias("geometry"),
            F.array("minx", "miny", "maxx", "maxy").alias("bbox"),
            F.col("assets"),
            F.col("links"),
        )
    )
