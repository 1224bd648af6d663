"""A zone layer that is cut once for a grid and met by the grids of many jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.constants import DEFAULT_BREAKS
from charscape.operators import grids, spatial, zonal
from charscape.operators.grids import GridGeometry
from charscape.operators.sizing import BROADCAST_BYTES

ZONE = ("zone_id", "veg_type")


@dataclass(frozen=True)
class ZoneLayer:
    """Zones as cells of a pixel grid, and the area of each type."""

    cells: DataFrame
    areas: DataFrame
    cell: int = spatial.CELL


def cut_layer(
    zones: DataFrame,
    grid: GridGeometry,
    utm_zone: int | None = None,
    cell: int = spatial.CELL,
    all_touched: bool = True,
) -> ZoneLayer:
    """Cells and areas of zones in map units, or in longitude and latitude with ``utm_zone``.

    The grid's units are metres. Nothing here depends on a job: store the result and read it for each.
    """
    metric = grids.project_zones(zones, utm_zone) if utm_zone is not None else zones
    placed = spatial.zones_in_grid_space(
        metric, grid.origin_x, grid.origin_y, grid.pixel_width, grid.pixel_height
    )
    return ZoneLayer(
        spatial.polygon_cells(placed, ZONE, cell, all_touched), zonal.zone_area(metric), cell
    )


def job_areas(jobs: DataFrame, areas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every job with the area of every type. Types are as few as vegetation has names, zones are many."""
    kinds = areas.agg(F.collect_list(F.struct("veg_type", "total_ha")).alias("kinds")).scalar()
    listed = jobs.select(*by).distinct().withColumn("kinds", kinds)
    return listed.select(*by, F.inline("kinds"))


def layer_matrix(
    layer: ZoneLayer,
    grid: DataFrame,
    jobs: DataFrame,
    pixel_ha: float,
    by: Sequence[str],
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    severity: str = "rbr",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The vegetation matrix of every job over one layer; a job without pixels has a matrix of zeros."""
    cells = layer.cells
    if spatial.stored_cells_fit(cells, layer.cell, broadcast_bytes):
        cells = F.broadcast(cells)
    pairs = spatial.join_cells(grid.select(*by, "row", "col", severity), cells, layer.cell)
    classes = zonal.zonal_classes(
        zonal.dissolve(pairs, by, [severity]), pixel_ha, measure, breaks, severity, by
    )
    return zonal.full_matrix(
        zonal.class_table(job_areas(jobs, layer.areas, by), classes, by), by
    )
