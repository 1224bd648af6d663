"""Job requests: checks, areas of interest, and the observations each job reads."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.constants import NIR_BAND, SWIR_BAND
from charscape.functions import areas, geometry
from charscape.functions.areas import AREA_CELL
from charscape.functions.geojson import parse_polygons
from charscape.functions.timeparse import ColumnWindow, hull
from charscape.operators.catalog import BBOX, JOB
from charscape.operators.sizing import BROADCAST_ROWS
from charscape.schemas import AREA, MONTH


def pre_window() -> ColumnWindow:
    return ColumnWindow(F.col("pre_start"), F.col("pre_end"))


def post_window() -> ColumnWindow:
    return ColumnWindow(F.col("post_start"), F.col("post_end"))


def check_requests(requests: DataFrame) -> DataFrame:
    """Adds rings, bounds and window bounds; ``status`` is ``error`` with a reason, or ``ready``.

    Both windows are required and have to be dates, and the geometry has to be a polygon.
    """
    times = {
        "pre_start": "prefire_start",
        "pre_end": "prefire_end",
        "post_start": "postfire_start",
        "post_end": "postfire_end",
    }
    given = geometry.all_of([F.trim(F.col(text)) != "" for text in times.values()])
    parsed = parse_polygons(requests, "geometry").withColumns(
        {name: F.col(text).try_cast("timestamp_ntz") for name, text in times.items()}
    )
    valid = geometry.all_of([F.col(name).isNotNull() for name in times])
    reason = (
        F.when(~F.coalesce(given, F.lit(False)), F.lit("both date windows are required"))
        .when(~valid, F.lit("malformed date"))
        .otherwise(F.col("reason"))
    )
    return parsed.withColumn("reason", reason).withColumns(
        {
            **geometry.ring_bounds(F.get("rings", F.lit(0))),
            "status": F.when(F.col("reason").isNull(), "ready").otherwise("error"),
        }
    )


def area_cells(requests: DataFrame, cell: float = AREA_CELL) -> DataFrame:
    """The map cells of each job's buffered bounds, with bounds and windows."""
    grown = geometry.buffered_bounds({c: F.col(c) for c in BBOX})
    boxes = requests.select(
        "job_id",
        "fire_event_name",
        "pre_start",
        "pre_end",
        "post_start",
        "post_end",
        *[column.alias(f"box_{name}") for name, column in grown.items()],
    )

    cells = boxes.withColumn(
        "area_x", areas.span(F.col("box_minx"), F.col("box_maxx"), cell)
    ).withColumn("area_y", areas.span(F.col("box_miny"), F.col("box_maxy"), cell))
    return cells


def in_storage_areas(cells: DataFrame) -> DataFrame:
    """One row for each storage area that can hold a cell's observations: of every level, as a table has
    areas of those levels that its writes have chosen."""
    place = areas.curve(F.col("area_x"), F.col("area_y"))
    return cells.withColumn(AREA, F.explode(areas.storage_areas(place)))


@dataclass(frozen=True)
class Reach:
    """What all ready jobs read together, and into how many cells they are cut."""

    cells: float
    box: tuple[float, float, float, float] | None
    times: tuple[datetime, datetime] | None


def reach(requests: DataFrame, cell: float) -> Reach:
    """One row, by one small aggregate over the requests."""
    grown = geometry.buffered_bounds({c: F.col(c) for c in BBOX})
    wide, high = (
        F.floor(grown[f"max{a}"] / cell) - F.floor(grown[f"min{a}"] / cell) + 1 for a in "xy"
    )
    found = requests.agg(
        F.sum((wide * high).cast("double")).alias("cells"),
        *[F.min(grown[c]).alias(c) for c in BBOX[:2]],
        *[F.max(grown[c]).alias(c) for c in BBOX[2:]],
        F.min("pre_start").alias("first"),
        F.max("post_end").alias("last"),
    ).first()
    if found["cells"] is None:
        return Reach(0.0, None, None)
    return Reach(
        found["cells"], tuple(found[c] for c in BBOX), (found["first"], found["last"])
    )


def within_reach(observations: DataFrame, found: Reach) -> DataFrame:
    """Observations that any job could read. The bounds are constants, so a stored table skips
    files by place and time, and whole months if it is stored by month."""
    if found.box is None:
        return observations.where(F.lit(False))
    first, last = (F.lit(t).cast("timestamp_ntz") for t in found.times)
    near = observations.where(
        F.col("x").between(found.box[0], found.box[2])
        & F.col("y").between(found.box[1], found.box[3])
        & F.col("ts").between(first, last)
    )
    if MONTH in observations.columns:
        near = near.where(F.col(MONTH).between(*(f"{t:%Y-%m}" for t in found.times)))
    return near


def job_observations(
    observations: DataFrame,
    requests: DataFrame,
    cell: float = AREA_CELL,
    limit: int = BROADCAST_ROWS,
    scenes: DataFrame | None = None,
) -> DataFrame:
    """The observations of each ready job: its bands, its buffered box, its windows.

    With ``scenes``, such as the result of a scene search, only observations of these; if scenes
    carry event and job, each job reads its own.

    Jobs are cut into map cells and meet the observations by an equi-join, so overlapping areas
    cost what they read. The job side is broadcast when its number of cells has been found small;
    otherwise both sides are shuffled and crowded cells are split at run time. In a table stored by area
    the join includes the area, so that the areas of the jobs at hand prune the scan when it runs:
    distant fires do not read what lies between them.
    """
    ready = requests.where(F.col("status") == "ready")
    # The comparison always holds; it tells the planner that the jobs are worth pruning by.
    cells = area_cells(ready, cell).where(F.col("box_minx") <= F.col("box_maxx"))
    found = reach(ready, cell)
    number, places = found.cells, ["area_x", "area_y"]
    if AREA in observations.columns and cell == AREA_CELL:
        cells, number, places = in_storage_areas(cells), number * len(areas.LEVELS), [AREA, *places]
    else:
        observations = observations.drop(AREA)
    if number <= limit:
        cells = F.broadcast(cells)
    near = within_reach(observations, found)
    own_scenes = scenes is not None and set(JOB) <= set(scenes.columns)
    if scenes is not None:
        near = near.join(scenes.select("scene_id").distinct(), "scene_id", "left_semi")
    keyed = near.where(F.col("band").isin(SWIR_BAND, NIR_BAND)).withColumns(
        {"area_x": areas.cell_of(F.col("x"), cell), "area_y": areas.cell_of(F.col("y"), cell)}
    )
    ts = F.col("ts")
    pre, post = pre_window(), post_window()
    read = hull(pre, post).contains(ts) & (pre.contains(ts) | post.contains(ts))
    met = (
        keyed.join(cells, places)
        .where(
            F.col("x").between(F.col("box_minx"), F.col("box_maxx"))
            & F.col("y").between(F.col("box_miny"), F.col("box_maxy"))
            & read
        )
    )
    if own_scenes:
        met = met.join(scenes.select(*JOB, "scene_id"), [*JOB, "scene_id"], "left_semi")
    return met.select(
        *["job_id", "fire_event_name", "pre_start", "pre_end", "post_start", "post_end"],
        *["tile_id", "row", "col", "band", "ts", "value"],
    )
