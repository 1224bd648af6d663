"""Polygon-to-pixel joins.

A predicate of inequalities alone would plan a nested loop. Polygons are therefore cut into square
cells of the pixel grid first, and pixels meet them by an equi-join on the cell:

* a cell no edge runs through lies wholly inside or outside: inside, its pixels need no test;
* a cell with edges becomes one bit mask per pixel row, and a pixel looks up its bit.

So the geometry is evaluated once per edge and pixel row, never per pixel, and the join's test
is integer arithmetic inside code generation. The cut is a scanline: an edge goes to the cells that it
crosses, and cells between them follow from the parity of the crossings to their right. Its cost is the
length of the outlines and the number of cells, so a polygon with very many vertices costs no more than
its edges, and one covering a third of the map is spread over tasks. A pixel's cell depends on its row
and column only, and a cell holds at most ``cell * cell`` pixels of one grid.

Coordinates are in grid space: x counts columns and y counts rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape.functions import geometry, masks
from charscape.functions.staging import stage
from charscape.operators.sizing import BROADCAST_BYTES

CELL = 32
CELL_KEY = ("cell_r", "cell_c")
BOUNDS = ("minx", "miny", "maxx", "maxy")
# Row and key overhead of one cell in a hashed relation; each mask adds twelve bytes.
_CELL_BYTES = 160


def zones_in_grid_space(
    zones: DataFrame,
    origin_x: float,
    origin_y: float,
    pixel_width: float,
    pixel_height: float,
) -> DataFrame:
    """Rings and bounds from map to pixel units. Pixel height is negative for north-up grids."""
    affine = [F.lit(float(v)) for v in (origin_x, origin_y, pixel_width, pixel_height)]
    moved = zones.withColumn(
        "rings", F.transform("rings", lambda r: geometry.to_grid_space(r, *affine))
    )
    return moved.withColumns(geometry.ring_bounds(F.flatten("rings")))


def polygon_cells(
    polygons: DataFrame, keys: Sequence[str], cell: int = CELL, all_touched: bool = True
) -> DataFrame:
    """Cells each polygon reaches; a cell without ``masks`` lies all inside.

    Needs a ``rings`` column. Polygons are told apart by ``keys`` and shape, and copies of one
    count once.
    """
    if not 0 < cell <= masks.MAX_WIDTH:
        raise ValueError(f"cells are 1 to {masks.MAX_WIDTH} pixels wide")
    shape = [*keys, "_shape"]
    band = [*shape, "cell_r"]
    e, y = F.col("e"), F.col("y")
    once = polygons.select(*keys, F.xxhash64("rings").alias("_shape"), "rings").dropDuplicates(shape)
    rows = once.select(*shape, F.explode(geometry.polygon_edges(F.col("rings"))).alias("e")).select(
        *shape, "e",
        F.explode(F.sequence(F.floor(F.least("e.y1", "e.y2")), F.floor(F.greatest("e.y1", "e.y2")))).alias("y"),
    )
    near = stage(rows, masks.scanline(e, y))
    cross, c_cell = F.col("cross_col"), F.floor(F.col("cross_col") / cell)
    first = F.least(F.floor(F.col("from_col") / cell), F.coalesce(c_cell, F.floor(F.col("from_col") / cell)))
    last = F.greatest(F.floor(F.col("to_col") / cell), F.coalesce(c_cell, F.floor(F.col("to_col") / cell)))
    left = F.col("cell_c") * cell
    own = F.coalesce(c_cell == F.col("cell_c"), F.lit(False))
    entries = near.withColumn("cell_r", F.floor(y / cell)).withColumn(
        "cell_c", F.explode(F.sequence(first, last))
    ).select(
        *band, "cell_c", (y - F.col("cell_r") * cell).alias("i"),
        F.when(own, masks.left_of(cross, left, cell)).otherwise(0).alias("filled"),
        F.when(own, 1).otherwise(0).cast("long").alias("odd"),
        (masks.touched(F.col("from_col"), F.col("past_col"), left, cell) if all_touched
         else F.lit(0).cast("long")).alias("touched"),
    )
    # One exchange: everything below stays within a polygon's band of cells.
    crossed = (
        entries.repartition(*band)
        .groupBy(*band, "cell_c", "i")
        .agg(F.bit_xor("filled").alias("filled"), F.bit_xor("odd").alias("odd"),
             F.bit_or("touched").alias("touched"))
        .groupBy(*band, "cell_c")
        .agg(
            F.collect_list(F.struct("i", "filled", "touched")).alias("_rows"),
            F.bit_or(masks.bit(F.col("i"))).alias("_known"),
            F.bit_xor(F.when(F.col("odd") == 1, masks.bit(F.col("i"))).otherwise(0)).alias("_odd"),
        )
    )
    right_first = Window.partitionBy(*band).orderBy(F.desc("cell_c"))
    carried = crossed.withColumns({
        # Rows with an odd number of crossings right of this cell, and of the gap that follows it.
        "_carry": F.coalesce(F.bit_xor("_odd").over(
            right_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_next": F.lag("cell_c").over(right_first),
    })
    return _cells(carried, [*keys, "cell_r"], cell)


def _cells(carried: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Crossed cells with their masks, and the cells of the gaps to their right that lie inside."""
    whole = F.lit(masks.full(cell)).cast("long")
    zero = F.lit(0).cast("long")
    own, carry = F.col("_c") == F.col("cell_c"), F.col("_carry")
    last = F.when(carry != 0, F.col("_next") - 1).otherwise(F.col("cell_c"))
    spread = carried.withColumn(
        "_c", F.explode(F.sequence("cell_c", F.greatest(F.coalesce(last, F.col("cell_c")), F.col("cell_c"))))
    )

    def row_mask(r: Column) -> Column:
        kept = F.when(masks.is_set(carry, r["i"]), whole).otherwise(zero)
        return F.struct(r["i"].cast("int").alias("i"),
                        r["filled"].bitwiseXOR(kept).bitwiseOR(r["touched"]).alias("mask"))

    # Rows without an edge of a cell: all inside or all outside.
    plain = F.when(own, carry.bitwiseAND(F.bitwise_not("_known"))).otherwise(carry)
    even = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(cell - 1)), lambda i: masks.is_set(plain, i)),
        lambda i: F.struct(i.alias("i"), whole.alias("mask")))
    edged = F.filter(F.transform("_rows", row_mask), lambda r: r["mask"] != 0)
    entries = F.concat(F.when(own, edged).otherwise(F.array().cast("array<struct<i:int,mask:bigint>>")), even)
    inside = ~own & (carry == whole)
    out = spread.select(
        *keys, F.col("_c").alias("cell_c"),
        F.when(~inside, F.map_from_entries(entries)).alias("masks"),
    )
    return out.where(F.col("masks").isNull() | (F.cardinality("masks") > 0))


def cells_fit_broadcast(
    polygons: DataFrame, cell: int = CELL, limit: int = BROADCAST_BYTES
) -> bool:
    """Upper bound of the cells' size, by one small aggregate over the polygons' bounds.

    Every polygon is charged as if each cell of its bounding box carried masks.
    """
    box = (
        {c: F.col(c) for c in BOUNDS}
        if set(BOUNDS) <= set(polygons.columns)
        else geometry.ring_bounds(F.flatten("rings"))
    )
    size = F.lit(float(cell))

    def cells(low: str, high: str) -> Column:
        return F.floor(box[high] / size) - F.floor(box[low] / size) + 1

    count = (cells("minx", "maxx") * cells("miny", "maxy")).cast("double")
    total = polygons.agg(F.sum(count).alias("cells")).first()["cells"]
    return total is None or total * (_CELL_BYTES + 12 * cell) <= limit


def stored_cells_fit(cells: DataFrame, cell: int = CELL, limit: int = BROADCAST_BYTES) -> bool:
    """Upper bound of the size of cells that are stored, from their number."""
    return cells.count() * (_CELL_BYTES + 12 * cell) <= limit


def with_cells(pixels: DataFrame, cell: int = CELL) -> DataFrame:
    size = F.lit(float(cell))
    return pixels.withColumns(
        {"cell_r": F.floor(F.col("row") / size), "cell_c": F.floor(F.col("col") / size)}
    )


def _cells_for_join(
    polygons: DataFrame,
    keys: Sequence[str],
    cell: int,
    all_touched: bool,
    broadcast_bytes: int,
) -> DataFrame:
    cells = polygon_cells(polygons, keys, cell, all_touched)
    return F.broadcast(cells) if cells_fit_broadcast(polygons, cell, broadcast_bytes) else cells


def _covered(cell: int) -> Column:
    return F.col("masks").isNull() | masks.has_bit(
        F.col("masks"), F.pmod("row", F.lit(cell)), F.pmod("col", F.lit(cell))
    )


def zone_pixel_join(
    pixels: DataFrame,
    zones: DataFrame,
    keys: Sequence[str] = ("zone_id", "veg_type"),
    all_touched: bool = True,
    cell: int = CELL,
    by: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (zone, pixel) where the zone touches the pixel or covers its centre.

    ``by`` names columns shared by both sides, such as a job, that must match as well; they have
    to be among ``keys``. The cell columns stay in the result: a later grouping that includes
    them needs no further shuffle.
    """
    return join_cells(pixels, _cells_for_join(zones, keys, cell, all_touched, broadcast_bytes), cell, by)


def join_cells(
    pixels: DataFrame, cells: DataFrame, cell: int = CELL, by: Sequence[str] = ()
) -> DataFrame:
    """The same with zones that have been cut into cells before."""
    return (
        with_cells(pixels, cell)
        .join(cells, [*by, *CELL_KEY], "inner")
        .where(_covered(cell))
        .drop("masks")
    )


def clip_grid(
    grid: DataFrame,
    polygons: DataFrame,
    by: Sequence[str] = (),
    cell: int = CELL,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pixels touched by a polygon, each once, columns unchanged.

    With ``by`` every pixel is clipped by the polygons of its own job.
    """
    cells = _cells_for_join(polygons, list(by), cell, True, broadcast_bytes).select(
        *[F.col(c).alias(f"_{c}") for c in (*by, *CELL_KEY)], "masks"
    )
    keyed = with_cells(grid, cell)
    match = geometry.all_of([keyed[c] == cells[f"_{c}"] for c in (*by, *CELL_KEY)])
    return keyed.join(cells, match & _covered(cell), "left_semi").drop(*CELL_KEY)


def rasterize_zones(
    spine: DataFrame,
    zones: DataFrame,
    value: str,
    order: str = "zone_id",
    fill: int = 0,
    cell: int = CELL,
    by: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Burn a value per zone into every pixel of a spine by the centre rule.

    Where zones overlap the last in ``order`` wins; pixels of no zone get ``fill``. The winners are found on
    the masks, and the spine is read once.
    """
    keys = list(dict.fromkeys([*by, order, value]))
    place = [*by, *CELL_KEY]
    cells = polygon_cells(zones, keys, cell, all_touched=False)
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(cell - 1)),
        lambda i: F.struct(i.alias("i"), F.lit(masks.full(cell)).cast("long").alias("mask")))
    rows = cells.repartition(*place).select(
        *keys, *CELL_KEY, F.explode(F.coalesce("masks", F.map_from_entries(whole))).alias("i", "mask"))
    above = F.bit_or("mask").over(
        Window.partitionBy(*place, "i").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    # Bits of later zones clear those of earlier ones, so a row of a cell has a winner for each pixel at most.
    won = rows.withColumn("_above", above).withColumn(
        "mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_above", F.lit(0)))))
    overlay = (
        won.where(F.col("mask") != 0)
        .groupBy(*place, "i").agg(F.collect_list(F.struct("mask", F.col(value).alias("value"))).alias("zones"))
        .groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("i", "zones"))).alias("_winners"))
    )
    if cells_fit_broadcast(zones, cell, broadcast_bytes):
        overlay = F.broadcast(overlay)
    candidates = F.try_element_at("_winners", F.pmod("row", F.lit(cell)).cast("int"))
    winner = F.get(
        F.filter(candidates, lambda z: masks.is_set(z["mask"], F.pmod("col", F.lit(cell)))), F.lit(0))
    return (
        with_cells(spine, cell).join(overlay, place, "left")
        .withColumn(value, F.coalesce(winner["value"], F.lit(fill)))
        .drop(*CELL_KEY, "_winners")
    )
