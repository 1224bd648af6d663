"""Map cells: small ones in which areas meet points and footprints, and those that observations are stored by.

A place is a square of STORED_CELLS small cells a side, numbered along a Z curve. It is computed from
the small cell, so that a stored row and a job's cell agree to the last bit. A storage area is a place or, where
these would make too many folders, a larger square: 2 to the power of its level places a side. Areas of
several levels can stand in one table: their numbers differ, and a place is an area of level 0 by its own number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Side of a small cell in map units.
AREA_CELL = 0.1
STORED_CELLS = 5
# Cells per axis: 2 to this power, half of them negative.
_BITS = 16
# Of storage areas; on the last level there is one area.
LEVELS = range(0, _BITS + 1, 2)


def cell_of(value: Column, side: float = AREA_CELL) -> Column:
    return F.floor(value / side)


def _spread(value: Column, shift: int) -> Column:
    """Every bit of a number at twice its place."""
    bits = [
        F.call_function("shiftleft", value.bitwiseAND(F.lit(1 << i).cast("long")), F.lit(i + shift))
        for i in range(_BITS)
    ]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def curve(cell_x: Column, cell_y: Column) -> Column:
    """The place of a small cell: neighbours mostly have numbers close by."""
    half = 1 << (_BITS - 1)
    x, y = (F.floor(c / STORED_CELLS) + half for c in (cell_x, cell_y))
    return _spread(x, 0).bitwiseOR(_spread(y, 1))


def place(x: Column, y: Column) -> Column:
    return curve(cell_of(x), cell_of(y))


def storage_area(place: Column, level: int) -> Column:
    """The area of a level that a place lies in; below zero for levels above 0."""
    if level == 0:
        return place
    return -(F.shiftright(place, 2 * level) * len(LEVELS) + LEVELS.index(level))


def storage_areas(place: Column) -> Column:
    """The areas of all levels that a place lies in."""
    return F.array(*[storage_area(place, level) for level in LEVELS])


def span(low: Column, high: Column, side: float) -> Column:
    """One row per cell between two bounds."""
    return F.explode(F.sequence(cell_of(low, side), cell_of(high, side)))
