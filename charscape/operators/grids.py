"""Whole-grid operators: metadata, overviews, projection, resampling, validity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.functions import projection
from charscape.functions.spectral import valid_value
from charscape.functions.staging import stage
from charscape.operators.zonal import pixel_area_ha


@dataclass(frozen=True)
class GridGeometry:
    """Origin and pixel size of a grid; a negative height means rows run southwards."""

    origin_x: float
    origin_y: float
    pixel_width: float
    pixel_height: float

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return (
            F.lit(self.origin_x) + (col + 0.5) * F.lit(self.pixel_width),
            F.lit(self.origin_y) + (row + 0.5) * F.lit(self.pixel_height),
        )

    def pixel_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (
            F.floor((y - F.lit(self.origin_y)) / F.lit(self.pixel_height)),
            F.floor((x - F.lit(self.origin_x)) / F.lit(self.pixel_width)),
        )


@dataclass(frozen=True)
class Tiling:
    """Tiles of a grid: squares of ``side`` pixels, ``stride`` numbers per row of tiles."""

    side: int = 16
    stride: int = 1000

    def tile_of(self, row: Column, col: Column) -> Column:
        return F.floor(row / self.side) * self.stride + F.floor(col / self.side)


def load_grid(
    grid: DataFrame, geometry: GridGeometry, severity: str = "rbr"
) -> DataFrame:
    """Severity with missing values as NULL, and the pixel area implied by the grid's units."""
    return grid.withColumns(
        {
            severity: valid_value(F.col(severity)),
            "pixel_area_ha": pixel_area_ha(
                F.lit(geometry.pixel_width), F.lit(geometry.pixel_height)
            ),
        }
    )


def overview_pyramid(
    grid: DataFrame, levels: int, value: str = "rbr", by: Sequence[str] = ()
) -> DataFrame:
    """Averages over 2, 4, 8 … pixels a side, missing pixels skipped.

    Each level adds up sums and counts of the one before. The union names every level's plan
    once more, but Spark runs each level's shuffle once and reuses it for the next.
    """
    current = grid.select(
        *by,
        F.col("row").cast("long").alias("row"),
        F.col("col").cast("long").alias("col"),
        F.col(value).cast("double").alias("total"),
        F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long").alias("pixels"),
    )
    out = []
    for level in range(1, levels + 1):
        current = (
            current.groupBy(
                *by,
                F.shiftright("row", 1).alias("row"),
                F.shiftright("col", 1).alias("col"),
            )
            .agg(F.sum("total").alias("total"), F.sum("pixels").alias("pixels"))
        )
        out.append(
            current.select(
                *by,
                F.lit(level).alias("level"),
                "row",
                "col",
                F.try_divide(F.col("total"), F.col("pixels")).alias(value),
                "pixels",
            )
        )
    return reduce(DataFrame.unionByName, out)


def project_points(
    points: DataFrame, lon: str = "lon", lat: str = "lat", zone: int = projection.DEFAULT_ZONE
) -> DataFrame:
    x, y = projection.utm_forward(F.col(lon), F.col(lat), zone)
    return points.withColumns({"utm_x": x, "utm_y": y})


def project_zones(zones: DataFrame, zone: int = projection.DEFAULT_ZONE) -> DataFrame:
    """Ring vertices from longitude and latitude to metres."""
    return zones.withColumn(
        "rings", F.transform("rings", lambda r: projection.project_ring(r, zone))
    )


def regrid_nearest(
    grid: DataFrame,
    source: GridGeometry,
    target: GridGeometry,
    values: Sequence[str] = ("rbr",),
    by: Sequence[str] = (),
    zone: int = projection.DEFAULT_ZONE,
    tiling: Tiling = Tiling(),
) -> DataFrame:
    """Nearest-neighbour resampling from a longitude/latitude grid to a projected one, with its tiles.

    The centre of every target pixel falls into exactly one source pixel. So each source pixel
    emits the target pixels whose centre it contains, picked from the few within its own reach.
    Nothing is shuffled and no target spine is built; target pixels without a source are absent.
    """
    lon, lat = source.centre(F.col("row"), F.col("col"))
    x, y = projection.utm_forward(lon, lat, zone)
    # Half a pixel's diagonal in metres, from the largest radius of curvature and 1 % for scale.
    metres = math.radians(1.0) * 6_400_000.0 * 1.01
    reach = math.hypot(source.pixel_width, source.pixel_height) / 2 * metres

    def candidates(centre: Column, origin: float, step: float) -> Column:
        ends = [(centre + F.lit(d) - F.lit(origin)) / F.lit(step) for d in (-reach, reach)]
        return F.explode(F.sequence(F.floor(F.least(*ends)), F.floor(F.greatest(*ends))))

    tried = (
        stage(grid.select(*by, "row", "col", *values), {"_x": x, "_y": y})
        .withColumn("t_row", candidates(F.col("_y"), target.origin_y, target.pixel_height))
        .withColumn("t_col", candidates(F.col("_x"), target.origin_x, target.pixel_width))
    )
    t_x, t_y = target.centre(F.col("t_row"), F.col("t_col"))
    located = projection.with_utm_inverse(tried, t_x, t_y, "_lon", "_lat", zone)
    row, col = source.pixel_of(F.col("_lon"), F.col("_lat"))
    return located.where((row == F.col("row")) & (col == F.col("col"))).select(
        *by,
        tiling.tile_of(F.col("t_row"), F.col("t_col")).alias("tile_id"),
        F.col("t_row").alias("row"),
        F.col("t_col").alias("col"),
        *values,
    )


def product_validity(
    indices: DataFrame,
    names: Sequence[str],
    by: Sequence[str] = ("fire_event_name", "job_id"),
    min_share: float = 0.0,
) -> DataFrame:
    """Per job and index: pixels, usable share, and whether the product may be published.

    A product is valid when it has pixels, more than ``min_share`` of them carry a value and
    no value is infinite. The job is complete when all of its products are.
    """
    infinite = float("inf")
    pixels = F.count("*")

    def usable(name: str) -> Column:
        return F.count(valid_value(F.col(name)))

    def finite(name: str) -> Column:
        bad = F.abs(valid_value(F.col(name))) == F.lit(infinite)
        return F.count(F.when(bad, F.lit(1))) == 0

    checks = {
        name: (F.try_divide(usable(name), pixels) > min_share) & finite(name) for name in names
    }
    table = indices.groupBy(*by).agg(
        pixels.alias("pixels"),
        *[F.coalesce(c, F.lit(False)).alias(f"{name}_valid") for name, c in checks.items()],
    )
    complete = reduce(lambda a, b: a & b, [F.col(f"{name}_valid") for name in names])
    return table.withColumn(
        "status", F.when(complete, F.lit("completed")).otherwise(F.lit("failed_validation"))
    )
