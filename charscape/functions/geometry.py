"""Planar polygon predicates and measures over arrays of edges.

A ring is ``array<struct<x, y>>`` and closed. A polygon is an array of rings, the outer ring
first; further rings are holes, or parts of their own with holes. Predicates take the polygon's edges, ``array<struct<x1, y1, x2, y2>>``, and contain no
division, so they need no guards and no tolerance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from charscape.constants import BUFFER_MAX_DEGREES, BUFFER_SHARE


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs; none for rings of fewer than two points."""

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        )

    starts = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), edge)


def polygon_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def to_grid_space(
    ring: Column, origin_x: Column, origin_y: Column, width: Column, height: Column
) -> Column:
    """Vertices in pixel units: x counts columns, y counts rows. ``height`` is negative when
    rows run southwards, as in north-up rasters."""
    return F.transform(
        ring,
        lambda p: F.struct(
            ((p["x"] - origin_x) / width).alias("x"), ((p["y"] - origin_y) / height).alias("y")
        ),
    )


def ring_area(ring: Column) -> Column:
    """Shoelace area, taken relative to the first vertex to keep precision far from the origin."""
    x0, y0 = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    twice = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc
        + ((e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)),
    )
    return F.abs(twice) / 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Lines lie at this share of their spacing, which keeps them off round coordinates.
_PHASE = (5**0.5 - 1) / 2
_STEPS = [1 << k for k in reversed(range(31))]


def _count_below(values: Column, limit: Column, steps: Column) -> Column:
    """How many of sorted values lie below a limit: a binary search."""
    return F.aggregate(
        steps, F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(values, at + s - 1) < limit, F.lit(False)), at + s).otherwise(at))


def _line_of(ring: Column) -> Column:
    """A height that crosses the ring. Rings of similar height share the lines of one spacing, so that a
    polygon of many rings has few lines; NULL for a ring without height."""
    ys = F.transform(ring, lambda p: p["y"])
    low = F.array_min(ys)
    height = F.array_max(ys) - low
    spacing = F.pow(F.lit(2.0), F.floor(F.log2(height)) - 1)
    return F.when(height > 0, (F.floor(low / spacing - _PHASE) + 1 + _PHASE) * spacing)


def _crossings(ring: Column, number: Column, lines: Column, steps: Column) -> Column:
    """Where a ring crosses the lines, from left to right on each, in the order that nesting asks for.

    Of crossings at one place, a ring's ends come before other rings' starts, and larger rings start first.
    ``area`` is given where the ring crosses its own line first.
    """

    def on_lines(e: Column) -> Column:
        up = e["y1"] <= e["y2"]
        x1, y1 = F.when(up, e["x1"]).otherwise(e["x2"]), F.least(e["y1"], e["y2"])
        x2, y2 = F.when(up, e["x2"]).otherwise(e["x1"]), F.greatest(e["y1"], e["y2"])
        first = _count_below(lines, y1, steps)
        met = F.slice(lines, first + 1, _count_below(lines, y2, steps) - first)
        return F.transform(met, lambda y: F.struct(
            y.alias("y"), (x1 + (y - y1) * (x2 - x1) / (y2 - y1)).alias("x")))

    def placed(found: Column) -> Column:
        own = F.array_position(F.transform(found, lambda c: c["y"]), _line_of(ring)) - 1
        area = ring_area(ring)
        return let(F.struct(own.alias("own"), area.alias("area")), lambda r: F.transform(
            found, lambda c, i: F.struct(
                c["y"].alias("y"), c["x"].alias("x"), (1 - i % 2).alias("starts"), (-r["area"]).alias("minus"),
                number.alias("ring"), F.when(i == r["own"], r["area"]).otherwise(0.0).alias("area"))))

    return let(F.array_sort(F.flatten(F.transform(ring_edges(ring), on_lines))), placed)


def polygon_area(rings: Column) -> Column:
    """Area by the even-odd rule, as for pixels: a ring inside an odd number of others is a hole,
    any other ring is a part of its own, and of two equal rings nothing is left.

    Rings may touch and share edges but not cross. Each is placed by a line across it: the rings that start
    or end left of its own start tell its depth. One sort of the crossings of all lines does this
    for all rings.
    """

    def summed(crossings: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("n"), F.lit(0.0).alias("area"))

        def step(state: Column, c: Column) -> Column:
            n = F.when(state["y"] == c["y"], state["n"]).otherwise(0)
            return F.struct(
                c["y"].alias("y"), (n + 1).alias("n"),
                (state["area"] + F.when(n % 2 == 0, c["area"]).otherwise(-c["area"])).alias("area"))

        return F.aggregate(crossings, start, step)["area"]

    def of_lines(lines: Column) -> Column:
        used = F.filter(F.array(*[F.lit(s) for s in _STEPS]), lambda s: s <= F.size(lines))
        return let(used, lambda steps: summed(F.array_sort(F.flatten(
            F.transform(rings, lambda r, i: _crossings(r, i, lines, steps))))))

    lines = F.array_sort(F.array_distinct(F.filter(F.transform(rings, _line_of), lambda y: y.isNotNull())))
    return F.when(F.size(rings) > 1, let(lines, of_lines)).otherwise(ring_area(F.get(rings, F.lit(0))))


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return {
        "minx": F.array_min(xs),
        "miny": F.array_min(ys),
        "maxx": F.array_max(xs),
        "maxy": F.array_max(ys),
    }


def buffered_bounds(bounds: dict[str, Column]) -> dict[str, Column]:
    """Bounds grown on each side by a share of the extent, at most a fixed width."""

    def grow(low: str, high: str) -> Column:
        return F.least(
            (bounds[high] - bounds[low]) * F.lit(BUFFER_SHARE), F.lit(BUFFER_MAX_DEGREES)
        )

    dx, dy = grow("minx", "maxx"), grow("miny", "maxy")
    return {
        "minx": bounds["minx"] - dx,
        "miny": bounds["miny"] - dy,
        "maxx": bounds["maxx"] + dx,
        "maxy": bounds["maxy"] + dy,
    }


def bounds_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (
        (a["minx"] <= b["maxx"])
        & (a["maxx"] >= b["minx"])
        & (a["miny"] <= b["maxy"])
        & (a["maxy"] >= b["miny"])
    )


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of edges crosses the ray from the point towards +x."""

    def crosses(e: Column) -> Column:
        dy = e["y2"] - e["y1"]
        side = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * dy
        return ((e["y1"] > y) != (e["y2"] > y)) & ((side > 0) == (dy > 0))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def edge_meets_box(
    e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, closed: bool = False
) -> Column:
    """Segment against box by separating axes: x, y and the segment's normal.

    An open box needs a piece of the segment inside; a closed one is met by contact. The corners' sides of the
    segment are compared as they are: a box that touches by a corner meets if that corner's own side says so.
    """
    sides = [
        (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        for x in (minx, maxx) for y in (miny, maxy)
    ]
    pairs = (
        (F.least(e["x1"], e["x2"]), maxx),
        (minx, F.greatest(e["x1"], e["x2"])),
        (F.least(e["y1"], e["y2"]), maxy),
        (miny, F.greatest(e["y1"], e["y2"])),
        (F.least(*sides), F.lit(0.0)),
        (F.lit(0.0), F.greatest(*sides)),
    )
    return all_of([low <= high if closed else low < high for low, high in pairs])


def edges_meet_box(
    edges: Column,
    minx: Column,
    miny: Column,
    maxx: Column,
    maxy: Column,
    closed: bool = False,
) -> Column:
    return F.exists(edges, lambda e: edge_meets_box(e, minx, miny, maxx, maxy, closed))


def polygon_meets_box(edges: Column, box: dict[str, Column]) -> Column:
    """An edge meets the closed box, or one of the two lies inside the other."""
    first = F.get(edges, F.lit(0))
    return (
        edges_meet_box(edges, box["minx"], box["miny"], box["maxx"], box["maxy"], closed=True)
        | contains_point(edges, box["minx"], box["miny"])
        | (
            first["x1"].between(box["minx"], box["maxx"])
            & first["y1"].between(box["miny"], box["maxy"])
        )
    )


def segments_meet(a: Column, b: Column) -> Column:
    """Closed segments share a point; collinear contact counts."""

    def turn(px: Column, py: Column, s: Column) -> Column:
        return F.signum(
            (s["x2"] - s["x1"]) * (py - s["y1"]) - (s["y2"] - s["y1"]) * (px - s["x1"])
        )

    def extent(s: Column) -> dict[str, Column]:
        return {
            "minx": F.least(s["x1"], s["x2"]),
            "miny": F.least(s["y1"], s["y2"]),
            "maxx": F.greatest(s["x1"], s["x2"]),
            "maxy": F.greatest(s["y1"], s["y2"]),
        }

    return (
        bounds_overlap(extent(a), extent(b))
        & (turn(b["x1"], b["y1"], a) * turn(b["x2"], b["y2"], a) <= 0)
        & (turn(a["x1"], a["y1"], b) * turn(a["x2"], a["y2"], b) <= 0)
    )


def polygons_intersect(a_edges: Column, b_edges: Column) -> Column:
    """Boundaries meet, or one polygon lies inside the other."""

    def starts_inside(inner: Column, outer: Column) -> Column:
        first = F.get(inner, F.lit(0))
        return contains_point(outer, first["x1"], first["y1"])

    meet = F.exists(a_edges, lambda a: F.exists(b_edges, lambda b: segments_meet(a, b)))
    return meet | starts_inside(a_edges, b_edges) | starts_inside(b_edges, a_edges)


def literal_edges(points: list[tuple[float, float]]) -> Column:
    """Edges of one closed ring known to the driver, such as an area of interest.

    A constant array: Spark folds it once instead of building it for every row.
    """
    return F.array(
        *[
            F.struct(
                F.lit(float(ax)).alias("x1"),
                F.lit(float(ay)).alias("y1"),
                F.lit(float(bx)).alias("x2"),
                F.lit(float(by)).alias("y2"),
            )
            for (ax, ay), (bx, by) in zip(points, points[1:])
        ]
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
