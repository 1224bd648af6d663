"""Search of the scene table and intersection with areas of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.constants import SCENE_COLLECTION
from charscape.functions import areas as map_areas
from charscape.functions import geometry
from charscape.functions.timeparse import ntz
from charscape.operators.catalog import BBOX, JOB
from charscape.operators.sizing import BROADCAST_ROWS

# Side of the cells in which footprints and areas meet, about the size of a footprint.
FOOTPRINT_CELL = 1.0
# Footprints of one shape in a list at most, and keys of areas of one shape. Spark holds what two lists make until it
# is passed on.
LISTED = 256
LISTED_KEYS = 64
# Tasks that the footprints of one shape are spread over, at least.
SPREAD = 8
# Keys in a list that take the room of a row in a broadcast.
_KEYS_A_ROW = 8


def bbox_of(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [x for x, _ in points], [y for _, y in points]
    return min(xs), min(ys), max(xs), max(ys)


def intersecting(df: DataFrame, aoi: list[tuple[float, float]], rings: str | None = None) -> DataFrame:
    """Rows whose footprint meets the area of interest.

    The bounding boxes are compared first, which the scan can prune by; only the survivors are
    tested exactly. Without a ``rings`` column the bounding box is the footprint.
    """
    box = {c: F.col(c) for c in BBOX}
    wanted = dict(zip(BBOX, (F.lit(float(v)) for v in bbox_of(aoi))))
    area = geometry.literal_edges(aoi)
    exact = (
        geometry.polygons_intersect(geometry.polygon_edges(F.col(rings)), area)
        if rings
        else geometry.polygon_meets_box(area, box)
    )
    return df.where(geometry.bounds_overlap(box, wanted) & exact)


def search_scenes(
    scenes: DataFrame,
    aoi: list[tuple[float, float]],
    start: str,
    end: str,
    collection: str = SCENE_COLLECTION,
    rings: str | None = None,
) -> DataFrame:
    """Scenes of a collection in an inclusive time range whose footprint meets the area."""
    in_time = scenes.where(
        (F.col("collection") == collection)
        & (F.col("ts") >= ntz(start))
        & (F.col("ts") <= ntz(end))
    )
    return intersecting(in_time, aoi, rings)


def _in_cells(df: DataFrame, prefix: str, cell: float) -> DataFrame:
    """One row for each map cell that the bounding box reaches."""
    for axis in "xy":
        low, high = F.col(f"{prefix}min{axis}"), F.col(f"{prefix}max{axis}")
        df = df.withColumn(f"cover_{axis}", map_areas.span(low, high, cell))
    return df


def _listed(df: DataFrame, values: Sequence[str], name: str, at_most: int) -> DataFrame:
    """One row for each shape, which all other columns make up, with a list of its values.

    Every row stands in one list, and a list has at most so many; a shape with more has several. The rows of a
    shape have to be in one partition, or else lists are shorter than they could be.
    """
    shape = [c for c in df.columns if c not in values]
    lists = F.expr(f"monotonically_increasing_id() div {at_most}")
    return (
        df.select(*shape, F.struct(*values).alias(name))
        .sortWithinPartitions(*shape)
        .withColumn("_list", lists)
        .groupBy(*shape, "_list")
        .agg(F.collect_list(name).alias(name))
        .drop("_list")
    )


def _spread(footprints: DataFrame, kept: Sequence[str], tasks: int) -> Column:
    """A number for each row by which the footprints of one shape are spread over tasks.

    There are as many numbers as an average bounding box fills lists, so that many shapes of few rows still make
    lists. They come from what the rows hold, however few files these are in.
    """
    seen = footprints.agg(
        F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*BBOX)).alias("boxes")).first()
    lists = seen["rows"] // (LISTED * max(1, seen["boxes"]))
    held = [c for c, kind in footprints.select(*kept).dtypes if "map<" not in kind and "variant" not in kind]
    return F.pmod(F.xxhash64(*held, F.spark_partition_id()), F.lit(max(SPREAD, min(tasks, lists))))


def cover_size(listed: DataFrame, prefix: str, name: str, cell: float) -> float:
    """How many rows the lists of shapes take in all map cells that their bounding boxes reach."""
    wide, high = (
        map_areas.cell_of(F.col(f"{prefix}max{a}"), cell) - map_areas.cell_of(F.col(f"{prefix}min{a}"), cell) + 1
        for a in "xy"
    )
    rows = wide * high * (1 + F.size(name) / _KEYS_A_ROW)
    return listed.agg(F.sum(rows.cast("double")).alias("n")).first()["n"] or 0.0


def meeting_pairs(
    footprints: DataFrame,
    areas: DataFrame,
    keys: Sequence[str],
    rings: str | None = None,
    cell: float = FOOTPRINT_CELL,
    limit: int = BROADCAST_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs of a footprint and an area that meet: the footprint's columns and the area's keys, each once.

    Areas need ``rings`` and bounds; footprints bounds and, unless these are the footprint, the
    column ``rings``. ``columns`` are those of the footprint that are wanted, all by default.

    Footprints of one shape are listed first, and so are areas: what meets is found once for two shapes, and only
    then every row of the one is paired with every key of the other. Shapes are cut into map cells and meet by an
    equi-join; a pair is taken in the cell that holds the lower left corner of what their boxes share, and only
    these are tested edge by edge. The areas are broadcast when the number of their cells has been found small.
    """
    kept = [c for c in columns or footprints.columns if c not in keys]
    shape = {f"_box_{c}": F.col(c) for c in BBOX} | ({"_rings": F.col(rings)} if rings else {})
    # Pairs are many more than the bytes that are shuffled suggest, so the number of tasks is given.
    tasks = int(footprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = _listed(
        footprints.select(
            *kept, *[c.alias(n) for n, c in shape.items()], _spread(footprints, kept, tasks).alias("_task")
        ).repartition(tasks, *shape, "_task"),
        kept, "_rows", LISTED,
    )
    outline = [*[f"_area_{c}" for c in BBOX], "_outline"]
    wanted = _listed(
        areas.select(*keys, *[F.col(c).alias(n) for n, c in zip(outline, [*BBOX, "rings"])]).repartition(*outline),
        keys, "_keys", LISTED_KEYS,
    )
    cut = _in_cells(
        wanted.withColumn("_edges", geometry.polygon_edges(F.col("_outline"))).drop("_outline"), "_area_", cell)
    if cover_size(wanted, "_area_", "_keys", cell) <= limit:
        cut = F.broadcast(cut)
    met = _in_cells(seen, "_box_", cell).join(cut, ["cover_x", "cover_y"])
    box, area = {c: F.col(f"_box_{c}") for c in BBOX}, {c: F.col(f"_area_{c}") for c in BBOX}
    first = geometry.all_of([
        map_areas.cell_of(F.greatest(box[f"min{a}"], area[f"min{a}"]), cell) == F.col(f"cover_{a}")
        for a in "xy"
    ])
    exact = (
        geometry.polygons_intersect(geometry.polygon_edges(F.col("_rings")), F.col("_edges"))
        if rings
        else geometry.polygon_meets_box(F.col("_edges"), box)
    )
    both = met.where(first & geometry.bounds_overlap(box, area)).where(exact)
    return both.select("_keys", F.inline("_rows")).select(*kept, F.inline("_keys")).select(*keys, *kept)


def search_scenes_of_jobs(
    scenes: DataFrame,
    jobs: DataFrame,
    keys: Sequence[str] = JOB,
    collection: str = SCENE_COLLECTION,
    rings: str | None = None,
    cell: float = FOOTPRINT_CELL,
    limit: int = BROADCAST_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Each job's scenes: of the collection, in the job's time from ``first`` to ``last``, on its area.

    ``columns`` are those of the scenes that are wanted, ``ts`` among them; all by default.
    """
    times = ["first", "last"]
    found = meeting_pairs(
        scenes.where(F.col("collection") == collection), jobs, [*keys, *times], rings, cell, limit, columns
    )
    return found.where(F.col("ts").between(F.col("first"), F.col("last"))).drop(*times)
