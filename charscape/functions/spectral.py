"""Burn indices and severity classes of one pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from charscape.constants import (
    DEFAULT_BREAKS,
    NODATA,
    RBR_OFFSET,
    RDNBR_ZERO_ROOT,
    SEVERITY_CLASSES,
    UNBURNED_CEILING,
    UNBURNED_FLOOR,
)


def valid_value(value: Column) -> Column:
    """NULL for NaN and the nodata marker, so that aggregates and comparisons skip them."""
    return F.when(~F.isnan(value) & (value != F.lit(NODATA)), value)


def stored_value(value: Column, fill_nodata: bool = False) -> Column:
    """Single-precision form written to grids; optionally with the nodata marker for NULL."""
    stored = value.cast("float")
    return F.coalesce(stored, F.lit(NODATA).cast("float")) if fill_nodata else stored


def nbr(nir: Column, swir: Column) -> Column:
    return F.try_divide(nir - swir, nir + swir)


def dnbr(pre: Column, post: Column) -> Column:
    return pre - post


def rdnbr(pre: Column, post: Column) -> Column:
    root = F.sqrt(F.abs(pre))
    return F.try_divide(
        dnbr(pre, post), F.when(root != 0, root).otherwise(F.lit(RDNBR_ZERO_ROOT))
    )


def rbr(pre: Column, post: Column) -> Column:
    return F.try_divide(dnbr(pre, post), pre + F.lit(RBR_OFFSET))


def class_conditions(
    severity: Column, breaks: tuple[float, float] = DEFAULT_BREAKS
) -> dict[str, Column]:
    """Half-open class ranges; values below the lowest edge belong to none."""
    edges = (UNBURNED_FLOOR, UNBURNED_CEILING, *breaks)
    conditions = {}
    for name, low, high in zip(SEVERITY_CLASSES, edges, (*edges[1:], None)):
        inside = severity >= F.lit(low)
        conditions[name] = inside if high is None else inside & (severity < F.lit(high))
    return conditions


def severity_class(
    severity: Column, breaks: tuple[float, float] = DEFAULT_BREAKS
) -> Column:
    conditions = class_conditions(severity, breaks)
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in conditions.items()])


def severity_mask(severity: Column, condition: Column) -> Column:
    """The severity value inside a class, 0 elsewhere."""
    return F.when(condition, severity).otherwise(F.lit(0.0))
