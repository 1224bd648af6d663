"""Bit masks of the pixels of a cell row that a polygon covers.

A cell is a square of pixels; each of its rows is one long, bit 0 being the leftmost pixel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One bit stays free so that no shift or difference overflows.
MAX_WIDTH = 62


def _ones(count: Column) -> Column:
    """The lowest ``count`` bits set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), count.cast("int")) - 1


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _x_at(e: Column, y: Column) -> Column:
    """Where a slanted edge passes the height ``y``; NULL for a level one."""
    return e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])


def scanline(e: Column, y: Column) -> dict[str, Column]:
    """What an edge does in the pixel row ``y``, in columns of the whole grid.

    ``from_col`` to ``to_col``: pixels that it comes near; ``past_col``: one past the last that it runs
    through, or NULL if it does not enter the row; ``cross_col``: how many pixel centres lie left of where it
    crosses their line, or NULL.
    """
    low = F.greatest(F.least(e["y1"], e["y2"]), y)
    high = F.least(F.greatest(e["y1"], e["y2"]), y + 1)
    a, b = F.coalesce(_x_at(e, low), e["x1"]), F.coalesce(_x_at(e, high), e["x2"])
    meets = (F.least(e["y1"], e["y2"]) < y + 1) & (F.greatest(e["y1"], e["y2"]) > y)
    line = y + 0.5
    crosses = (e["y1"] > line) != (e["y2"] > line)
    return {
        "from_col": F.floor(F.least(a, b)),
        "to_col": F.floor(F.greatest(a, b)),
        "past_col": F.when(meets, F.ceil(F.greatest(a, b))),
        "cross_col": F.when(crosses, F.ceil(_x_at(e, line) - 0.5)),
    }


def touched(from_col: Column, past_col: Column, left: Column, width: int) -> Column:
    """Pixels of a cell row from one column to another."""
    first, past = _clamp(from_col - left, 0, width), _clamp(past_col - left, 0, width)
    return F.when(past > first, _ones(past) - _ones(first)).otherwise(F.lit(0).cast("long"))


def left_of(cross_col: Column, left: Column, width: int) -> Column:
    """Pixels of a cell row left of a crossing."""
    return F.coalesce(_ones(_clamp(cross_col - left, 0, width)), F.lit(0).cast("long"))


def bit(index: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int"))


def is_set(mask: Column, index: Column) -> Column:
    return F.call_function("shiftright", mask, index.cast("int")).bitwiseAND(F.lit(1)) == 1


def full(width: int) -> int:
    return (1 << width) - 1


def has_bit(masks: Column, row: Column, col: Column) -> Column:
    """Whether the pixel at this row and column of the cell is set; rows may be absent."""
    return F.coalesce(is_set(F.try_element_at(masks, row.cast("int")), col), F.lit(False))
