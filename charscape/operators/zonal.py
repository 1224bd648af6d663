"""Zonal statistics of severity classes and the vegetation impact matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape.constants import (
    CLASS_MIDPOINTS,
    DEFAULT_BREAKS,
    MATRIX_COLUMNS,
    SEVERITY_CLASSES,
    SQUARE_METRES_PER_HECTARE,
)
from charscape.functions import geometry, naming, spectral
from charscape.operators.sizing import BROADCAST_BYTES
from charscape.operators.spatial import CELL, CELL_KEY, zone_pixel_join

CLASS_HA = tuple(f"{name}_ha" for name in SEVERITY_CLASSES)
BURNT_HA = CLASS_HA[1:]


def pixel_area_ha(width: Column, height: Column) -> Column:
    return F.abs(width) * F.abs(height) / SQUARE_METRES_PER_HECTARE


def zone_area_ha(rings: Column, square_metres_per_unit: float = 1.0) -> Column:
    """Polygon area in hectares; one square unit of the rings is that many square metres."""
    return geometry.polygon_area(rings) * square_metres_per_unit / SQUARE_METRES_PER_HECTARE


def zone_area(
    zones: DataFrame, square_metres_per_unit: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Sum of polygon areas per type, overlaps counted for each polygon."""
    return zones.groupBy(*by, "veg_type").agg(
        F.sum(zone_area_ha(F.col("rings"), square_metres_per_unit)).alias("total_ha"),
        F.count("*").alias("polygons"),
    )


def veg_types(zones: DataFrame) -> DataFrame:
    return zones.groupBy("veg_type").agg(F.count("*").alias("polygons"))


def total_bounds(zones: DataFrame) -> DataFrame:
    return zones.agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )


def dissolve(pairs: DataFrame, by: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """Each (type, pixel) once, however many polygons of the type touch the pixel.

    The grouping contains the join's cell key, so after a shuffled join it stays in place.
    ``values`` depend on the pixel alone.
    """
    return pairs.select(*by, "veg_type", *CELL_KEY, "row", "col", *values).distinct()


def zonal_classes(
    dissolved: DataFrame,
    pixel_ha: float,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per type one column per class, in hectares.

    ``area`` counts pixels; ``value_sum`` adds up the severity values, as the masks do.
    Partial sums are taken per task, so a dominant type costs no more than others.
    """
    if measure not in ("area", "value_sum"):
        raise ValueError(f"unknown measure {measure!r}")
    value = F.col(severity)

    def total(condition: Column) -> Column:
        if measure == "area":
            return F.count(F.when(condition, F.lit(1))) * F.lit(pixel_ha)
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)) * F.lit(pixel_ha)

    conditions = spectral.class_conditions(value, breaks)
    return dissolved.groupBy(*by, "veg_type").agg(
        *[total(condition).alias(f"{name}_ha") for name, condition in conditions.items()]
    )


def zonal_raw(
    dissolved: DataFrame, pixel_ha: float, severity: str = "rbr", by: Sequence[str] = ()
) -> DataFrame:
    """Sum, mean and area-weighted sum of the unclassified severity per type."""
    return dissolved.groupBy(*by, "veg_type").agg(
        F.sum(severity).alias("severity_sum"),
        F.avg(severity).alias("severity_mean"),
        (F.coalesce(F.sum(severity), F.lit(0.0)) * F.lit(pixel_ha)).alias("original_ha"),
        F.count("*").alias("pixels"),
    )


def class_table(areas: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Areas and class hectares per type; types without pixels have zeros.

    Stacking and adding keeps the row of the NULL type, which an equi-join would lose.
    """
    stacked = areas.select(*by, "veg_type", "total_ha").unionByName(
        classes, allowMissingColumns=True
    )
    return stacked.groupBy(*by, "veg_type").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in (*CLASS_HA, "total_ha")]
    )


def burnt_ha() -> Column:
    return sum((F.col(c) for c in BURNT_HA[1:]), F.col(BURNT_HA[0]))


def _totals() -> dict[str, Column]:
    return {
        "park_ha": F.sum("total_ha"),
        "burnt_ha": F.sum(burnt_ha()),
        "unburnt_ha": F.sum("unburned_ha"),
    }


def park_totals(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area, burnt and unburnt area of all types together."""
    return table.groupBy(*by).agg(*[c.alias(name) for name, c in _totals().items()])


def with_totals(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total area and burnt area beside each type.

    Without groups a scalar subquery takes all totals at once. It reads every column of the
    table, so its plan down to the last shuffle equals that of the table itself and Spark reuses
    the shuffle: observations are scanned once. With groups a window over the few types of each
    group does the same.
    """
    if by:
        window = Window.partitionBy(*by)
        return table.withColumns(
            {name: c.over(window) for name, c in _totals().items() if name != "unburnt_ha"}
        )
    totals = table.agg(F.struct(*[c.alias(name) for name, c in _totals().items()]).alias("all"))
    everything = totals.scalar()
    return table.withColumns(
        {"park_ha": everything["park_ha"], "burnt_ha": everything["burnt_ha"]}
    )


def class_percent(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_ha"), F.col("total_ha")) * 100


def with_percentages(table: DataFrame, digits: int | None = None) -> DataFrame:
    """Share of each class in the type's area, in percent."""
    columns = {f"{name}_percent": class_percent(name) for name in SEVERITY_CLASSES}
    if digits is not None:
        columns = {name: F.bround(c, digits) for name, c in columns.items()}
    return table.withColumns(columns)


def _midpoint(name: str, breaks: tuple[float, float] | None) -> float:
    """Fixed midpoints, or on request those of the inner classes from the breaks."""
    if breaks is not None and name == "low":
        return (0.1 + breaks[0]) / 2
    if breaks is not None and name == "moderate":
        return (breaks[0] + breaks[1]) / 2
    if breaks is not None and name == "high":
        return (breaks[1] + 1.0) / 2
    return CLASS_MIDPOINTS[name]


def mean_severity(midpoints_from: tuple[float, float] | None = None) -> Column:
    """Midpoints weighted by class hectares over the type's polygon area; 0 without area."""
    weighted = sum(
        (
            F.col(f"{name}_ha") * F.lit(_midpoint(name, midpoints_from))
            for name in SEVERITY_CLASSES[1:]
        ),
        F.col("unburned_ha") * F.lit(_midpoint("unburned", midpoints_from)),
    )
    return F.coalesce(F.try_divide(weighted, F.col("total_ha")), F.lit(0.0))


def std_severity(mean: Column, midpoints_from: tuple[float, float] | None = None) -> Column:
    """Deviation around the mean with the same weights; NULL for a negative radicand."""

    def term(name: str) -> Column:
        distance = F.lit(_midpoint(name, midpoints_from)) - mean
        return F.col(f"{name}_ha") * (distance * distance)

    spread = sum((term(name) for name in SEVERITY_CLASSES[1:]), term("unburned"))
    variance = F.try_divide(spread, F.col("total_ha"))
    return F.when(
        F.col("total_ha") > 0, F.when(variance >= 0, F.sqrt(variance))
    ).otherwise(F.lit(0.0))


def with_severity(
    table: DataFrame, midpoints_from: tuple[float, float] | None = None
) -> DataFrame:
    return table.withColumn("mean_severity", mean_severity(midpoints_from)).withColumn(
        "std_severity", std_severity(F.col("mean_severity"), midpoints_from)
    )


def with_shares(table: DataFrame) -> DataFrame:
    """Percent of all area and of all burnt area; needs the totals columns."""
    return table.withColumns(
        {
            "pct_of_park": F.try_divide(F.col("total_ha"), F.col("park_ha")) * 100,
            "pct_of_burn": F.try_divide(burnt_ha(), F.col("burnt_ha")) * 100,
        }
    )


def zone_class_table(
    grid: DataFrame,
    zones: DataFrame,
    pixel_ha: float,
    square_metres_per_unit: float,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
    by: Sequence[str] = (),
    cell: int = CELL,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """From grid and zones to class hectares per type: one join, one grouping."""
    pairs = zone_pixel_join(
        grid.select(*by, "row", "col", severity),
        zones,
        list(dict.fromkeys([*by, "zone_id", "veg_type"])),
        cell=cell,
        by=by,
        broadcast_bytes=broadcast_bytes,
    )
    classes = zonal_classes(
        dissolve(pairs, by, [severity]), pixel_ha, measure, breaks, severity, by
    )
    return class_table(zone_area(zones, square_metres_per_unit, by), classes, by)


def veg_fire_matrix(
    grid: DataFrame,
    zones: DataFrame,
    pixel_ha: float,
    square_metres_per_unit: float,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
    by: Sequence[str] = (),
    cell: int = CELL,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hectares, shares, mean severity and deviation per vegetation type, unrounded."""
    table = zone_class_table(
        grid, zones, pixel_ha, square_metres_per_unit, measure, breaks, severity, by, cell,
        broadcast_bytes,
    )
    return full_matrix(table, by)


def full_matrix(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All columns of the matrix from areas and class hectares."""
    return with_severity(with_shares(with_percentages(with_totals(table, by)))).withColumn(
        "color", naming.colour(F.col("veg_type"))
    )


def present(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The seven published columns, rounded half to even."""
    columns = (
        F.col("color"),
        F.col("veg_type"),
        F.bround("total_ha", 2),
        F.bround("pct_of_park", 2),
        F.bround("pct_of_burn", 2),
        F.bround("mean_severity", 3),
        F.bround("std_severity", 3),
    )
    return matrix.select(*by, *[c.alias(n) for c, n in zip(columns, MATRIX_COLUMNS)])
