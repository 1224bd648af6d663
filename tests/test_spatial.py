"""The polygon join against brute force, in every physical form."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from charscape.functions import geometry
from charscape.operators import scenes, spatial, zonal

POLYGON = "zone_id long, veg_type string, rings array<array<struct<x:double,y:double>>>"


def star(seed: int, cx: float, cy: float, radius: float, points: int) -> list:
    rng = random.Random(seed)
    ring = []
    for i in range(points):
        r = radius * rng.uniform(0.4, 1.0)
        a = 2 * math.pi * i / points
        ring.append((cx + r * math.cos(a) + 0.0137, cy + r * math.sin(a) + 0.0071))
    return ring + ring[:1]


def edges_of(rings: list) -> list:
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]


def inside(rings: list, x: float, y: float) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in edges_of(rings):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


def passes(rings: list, row: int, col: int) -> bool:
    """Liang-Barsky clipping of every edge by the pixel."""
    for (x1, y1), (x2, y2) in edges_of(rings):
        low, high = 0.0, 1.0
        for p, d, edge in ((x1, x2 - x1, col), (y1, y2 - y1, row)):
            if d == 0:
                if not edge < p < edge + 1:
                    high = -1.0
                continue
            a, b = sorted(((edge - p) / d, (edge + 1 - p) / d))
            low, high = max(low, a), min(high, b)
        if low < high:
            return True
    return False


ZONES = [
    (1, "pine", [star(1, 20, 20, 18, 11)]),
    (2, "pine", [star(2, 30, 24, 12, 7)]),
    (3, "oak", [star(3, 12, 33, 9, 40), star(4, 12, 33, 3, 9)]),
    (4, None, [star(5, 40, 8, 6, 5)]),
    (5, "ash", [star(6, 300, 300, 4, 6)]),
    # Thin sliver without any pixel centre.
    (6, "ash", [[(2.1, 2.1), (44.2, 3.3), (44.2, 3.31), (2.1, 2.11), (2.1, 2.1)]]),
]
SIZE = 48


def as_rows(zones):
    return [
        (z, t, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for z, t, rings in zones
    ]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(as_rows(ZONES), POLYGON)


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.range(SIZE * SIZE).select(
        F.expr(f"id div {SIZE}").alias("row"), (F.col("id") % SIZE).alias("col")
    )


def brute(test) -> set:
    return {
        (z, r, c)
        for z, _, rings in ZONES
        for r in range(SIZE)
        for c in range(SIZE)
        if test(rings, r, c)
    }


def centre(rings, r, c):
    return inside(rings, c + 0.5, r + 0.5)


def touched(rings, r, c):
    return centre(rings, r, c) or passes(rings, r, c)


@pytest.mark.parametrize("cell", [4, 16, 62])
@pytest.mark.parametrize("broadcast_bytes", [0, spatial.BROADCAST_BYTES])
def test_join_equals_brute_force(spark, zones, pixels, cell, broadcast_bytes):
    for all_touched, test in ((True, touched), (False, centre)):
        got = spatial.zone_pixel_join(
            pixels, zones, all_touched=all_touched, cell=cell, broadcast_bytes=broadcast_bytes
        ).select("zone_id", "row", "col").collect()
        assert len(got) == len(set(got))
        assert {tuple(x) for x in got} == brute(test)


def test_copies_of_a_zone_count_once(spark, pixels):
    twice = spark.createDataFrame(as_rows(ZONES[:2] * 2), POLYGON)
    once = spark.createDataFrame(as_rows(ZONES[:2]), POLYGON)
    join = spatial.zone_pixel_join
    assert sorted(join(pixels, twice).collect()) == sorted(join(pixels, once).collect())


def test_interior_cells_carry_no_edges(spark):
    block = [[(0.5, 0.5), (63.5, 0.5), (63.5, 63.5), (0.5, 63.5), (0.5, 0.5)]]
    zone = spark.createDataFrame(as_rows([(1, "x", block)]), POLYGON)
    cells = spatial.polygon_cells(zone, ["zone_id"], 8).collect()
    assert len(cells) == 64
    assert sum(c["masks"] is None for c in cells) == 36


def test_dissolve_is_distinct_by_type_and_pixel(spark, zones, pixels):
    pairs = spatial.zone_pixel_join(pixels, zones, cell=8)
    got = {(x["veg_type"], x["row"], x["col"]) for x in zonal.dissolve(pairs).collect()}
    kinds = {z: t for z, t, _ in ZONES}
    assert got == {(kinds[z], r, c) for z, r, c in brute(touched)}


def test_clip_keeps_touched_pixels_and_is_idempotent(spark, zones, pixels):
    one = zones.where("zone_id = 3").select("rings")
    clipped = spatial.clip_grid(pixels, one, cell=8)
    got = {tuple(x) for x in clipped.collect()}
    assert got == {(r, c) for z, r, c in brute(touched) if z == 3}
    assert {tuple(x) for x in spatial.clip_grid(clipped, one, cell=8).collect()} == got


def test_clip_to_bounds_is_identity(spark, pixels):
    whole = [[(-1.5, -1.5), (60.5, -1.5), (60.5, 60.5), (-1.5, 60.5), (-1.5, -1.5)]]
    box = spark.createDataFrame(as_rows([(1, "x", whole)]), POLYGON).select("rings")
    assert spatial.clip_grid(pixels, box).count() == SIZE * SIZE


@pytest.mark.parametrize("broadcast_bytes", [0, spatial.BROADCAST_BYTES])
def test_clip_by_job(spark, pixels, broadcast_bytes):
    grids = pixels.withColumn("job_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    rows = as_rows([(1, "a", ZONES[0][2]), (2, "b", ZONES[1][2])])
    polygons = spark.createDataFrame(rows, POLYGON).withColumnRenamed("veg_type", "job_id")
    got = spatial.clip_grid(
        grids, polygons, by=["job_id"], cell=8, broadcast_bytes=broadcast_bytes
    ).collect()
    expected = {("a" if z == 1 else "b", r, c) for z, r, c in brute(touched) if z in (1, 2)}
    assert {(x["job_id"], x["row"], x["col"]) for x in got} == expected
    assert len(got) == len(expected)


def test_last_zone_wins_and_fill_covers_the_rest(spark, zones, pixels):
    got = {
        (x["row"], x["col"]): x["zone_id"]
        for x in spatial.rasterize_zones(
            pixels, zones.withColumn("order", F.col("zone_id")), "zone_id", order="order"
        ).collect()
    }
    expected = {(r, c): 0 for r in range(SIZE) for c in range(SIZE)}
    for z, r, c in sorted(brute(centre)):
        expected[(r, c)] = z
    assert got == expected


def test_crowded_cell(spark, pixels):
    """A third of all polygons lies in one cell."""
    rows = [(i, "x", [star(i, 5, 5, 3, 5)]) for i in range(200)]
    rows += [(200 + i, "y", [star(i, 7 + i % 40, 8 + i % 37, 5, 5)]) for i in range(400)]
    crowd = spark.createDataFrame(as_rows(rows), POLYGON)
    small = spatial.zone_pixel_join(pixels, crowd, cell=16)
    large = spatial.zone_pixel_join(pixels, crowd, cell=16, broadcast_bytes=0)
    expected = sum(touched(r, y, x) for _, _, r in rows for y in range(14) for x in range(14))
    assert small.where("row < 14 and col < 14").count() == expected
    assert sorted(small.collect()) == sorted(large.collect())


def test_area_with_hole(spark):
    outer = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]
    shifted = [[(x + 5e5, y + 3.7e6) for x, y in ring] for ring in (outer, hole)]
    df = spark.createDataFrame(as_rows([(1, "x", shifted)]), POLYGON)
    area = df.select(geometry.polygon_area(F.col("rings")).alias("a")).first()["a"]
    assert area == 96.0


def test_buffer_is_a_share_of_the_extent_up_to_a_limit(spark):
    rows = [(0.0, 0.0, 1.0, 10.0)]
    df = spark.createDataFrame(rows, "minx double, miny double, maxx double, maxy double")
    grown = geometry.buffered_bounds({c: F.col(c) for c in df.columns})
    got = df.select(*[v.alias(k) for k, v in grown.items()]).first()
    assert tuple(got) == (-0.2, -0.25, 1.2, 10.25)


def test_polygons_intersect(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    cases = {
        1: ([(1, 1), (2, 1), (2, 2), (1, 1)], True),
        2: ([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], True),
        3: ([(3, 3), (6, 3), (6, 6), (3, 3)], True),
        4: ([(4, 4), (6, 4), (6, 6), (4, 4)], True),
        5: ([(5, 0), (9, 0), (5, 4.5), (5, 0)], False),
        6: ([(-1, 2), (5, 3), (5, 3.1), (-1, 2)], True),
        7: ([(3.5, 4.6), (4.6, 3.5), (9, 9), (3.5, 4.6)], False),
    }
    df = spark.createDataFrame(
        as_rows([(k, "x", [[(float(x), float(y)) for x, y in ring]]) for k, (ring, _) in cases.items()]),
        POLYGON,
    ).withColumns(geometry.ring_bounds(F.get("rings", F.lit(0))))
    got = {r["zone_id"] for r in scenes.intersecting(df, square, "rings").collect()}
    assert got == {k for k, (_, hit) in cases.items() if hit}
    boxes = {r["zone_id"] for r in scenes.intersecting(df, square).collect()}
    assert boxes == {1, 2, 3, 4, 6, 7}


def comb(teeth: int) -> list[tuple[float, float]]:
    """A polygon whose teeth all cross one band of cells."""
    points = []
    for i in range(teeth):
        points += [(0.3 + i / 4, 0.3), (0.4 + i / 4, 30.3)]
    return [*points, (points[-1][0], 40.0), (0.3, 40.0), points[0]]


def test_cells_of_a_comb_grow_with_its_edges(spark):
    """Each doubling of the edges costs 2.3 times as much at most."""

    def seconds(teeth: int) -> float:
        zone = spark.createDataFrame([(1, "x", [comb(teeth)])], POLYGON).cache()
        zone.count()
        start = time.perf_counter()
        spatial.polygon_cells(zone, ["zone_id"]).agg(F.count("masks")).collect()
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) <= 2 * 2.3 * max(seconds(4_000), 1.0)


def test_comb_equals_brute_force(spark):
    rings = [comb(12)]
    zone = spark.createDataFrame(as_rows([(1, "x", rings)]), POLYGON)
    grid = spark.range(44 * 8).select(F.expr("id div 8").alias("row"), (F.col("id") % 8).alias("col"))
    for all_touched, test in ((True, touched), (False, centre)):
        got = spatial.zone_pixel_join(grid, zone, all_touched=all_touched, cell=5)
        assert {(r["row"], r["col"]) for r in got.collect()} == {
            (r, c) for r in range(44) for c in range(8) if test(rings, r, c)}


@pytest.mark.parametrize("cell", [4, 7, 62])
def test_edges_on_pixel_borders(spark, cell):
    """Steps whose level and upright edges run along borders of pixels and cells."""
    steps = [(0, 0), (12, 0), (12, 4), (20, 4), (20, 9), (8, 9), (8, 16), (3, 16), (3, 9), (0, 9), (0, 0)]
    hole = [(4, 4), (8, 4), (8, 8), (4, 8), (4, 4)]
    rings = [[(float(x), float(y)) for x, y in ring] for ring in (steps, hole)]
    zone = spark.createDataFrame(as_rows([(1, "x", rings)]), POLYGON)
    grid = spark.range(24 * 24).select(F.expr("id div 24").alias("row"), (F.col("id") % 24).alias("col"))
    want = {(r, c) for r in range(24) for c in range(24) if centre(rings, r, c)}
    for all_touched in (True, False):
        got = spatial.zone_pixel_join(grid, zone, all_touched=all_touched, cell=cell).collect()
        assert {(r["row"], r["col"]) for r in got} == want and len(got) == len(want)


def square(x: float, y: float, side: float = 1.0) -> list[tuple[float, float]]:
    x, y = float(x), float(y)
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def area_of(spark, rings) -> float:
    df = spark.createDataFrame(as_rows([(1, "x", rings)]), POLYGON)
    return df.select(geometry.polygon_area(F.col("rings")).alias("a")).first()["a"]


def test_areas_of_many_rings(spark):
    start = time.perf_counter()
    assert area_of(spark, [square(2.0 * i, 0.0) for i in range(800)]) == 800
    assert time.perf_counter() - start < 10
    lakes = [square(-1.0, -1.0, 400.0)] + [square(2.0 * (i % 100), 2.0 * (i // 100)) for i in range(9999)]
    assert area_of(spark, lakes) == 160_000 - 9999
    assert area_of(spark, [square(float(i), float(i), 2.0 * (50 - i)) for i in range(50)]) == sum(
        (-1) ** i * (2 * (50 - i)) ** 2 for i in range(50))


def test_rings_that_touch_or_repeat(spark):
    assert area_of(spark, [square(0, 0, 4.0), square(4, 0, 4.0)]) == 32
    assert area_of(spark, [square(4, 0, 4.0), square(0, 0, 4.0)]) == 32
    # A hole along the left edge, either way round.
    assert area_of(spark, [square(0, 0, 4.0), square(0, 1, 2.0)]) == 12
    assert area_of(spark, [square(0, 1, 2.0), square(0, 0, 4.0)]) == 12
    # Of two equal rings nothing is left, of three one.
    assert area_of(spark, [square(0, 0, 4.0)] * 2) == 0
    assert area_of(spark, [square(0, 0, 4.0)] * 3) == 16
    twice = spark.createDataFrame(as_rows([(1, "x", [square(0.5, 0.5, 4.0)] * 2)]), POLYGON)
    grid = spark.range(36).select(F.expr("id div 6").alias("row"), (F.col("id") % 6).alias("col"))
    assert spatial.zone_pixel_join(grid, twice, all_touched=False, cell=4).count() == 0
    assert area_of(spark, [square(0, 0, 4.0), [(1.0, 1.0), (1.0, 1.0)]]) == 16


def test_contact_of_box_and_triangle_follows_the_sides_of_the_corners(spark):
    """Boxes of 120 places and triangles of 40 others that touch or miss by the last bit."""
    keys = [1307, 153, 155, 459, 863, 962, 963, 787, *range(1, 33)]
    areas, boxes = [], []
    for k in keys:
        x, y = -120.0 + k % 37 * 0.21, 32.0 + k * 7 % 41 * 0.17
        areas.append((k, [[(x, y), (x + 0.8, y + 0.3), (x + 0.2, y + 0.9), (x, y)]], x, y, x + 0.8, y + 0.9))
    for k in range(120):
        x, y = -120.0 + k % 40 * 0.1, 33.0 + k % 30 * 0.1
        boxes.append((k, x, y, x + 0.2, y + 0.2))

    def meets(area, box) -> bool:
        (_, rings, *bounds), (_, minx, miny, maxx, maxy) = area, box
        if minx > bounds[2] or maxx < bounds[0] or miny > bounds[3] or maxy < bounds[1]:
            return False
        return all(
            max((bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (minx, maxx) for y in (miny, maxy)) >= 0
            for (ax, ay), (bx, by) in zip(rings[0], rings[0][1:], strict=False))

    bounds = "minx double, miny double, maxx double, maxy double"
    found = scenes.meeting_pairs(
        spark.createDataFrame(boxes, f"box long, {bounds}"),
        spark.createDataFrame(areas, f"area long, rings array<array<struct<x:double,y:double>>>, {bounds}"), ["area"])
    assert {(r["area"], r["box"]) for r in found.collect()} == {
        (a[0], b[0]) for a in areas for b in boxes if meets(a, b)}


BOUNDS = "minx double, miny double, maxx double, maxy double"
RINGS = "rings array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize("limit", [0, scenes.BROADCAST_ROWS])
def test_shapes_are_compared_once_for_all_their_rows(spark, monkeypatch, limit):
    """1,000 footprints of one place against 100 areas of one outline: few lists of them are compared."""
    compared = spark.sparkContext.accumulator(0)

    def counted(edges, box):
        def meets(edges, minx):
            compared.add(1)
            return True

        return F.udf(meets, "boolean")(edges, box["minx"])

    monkeypatch.setattr(geometry, "polygon_meets_box", counted)
    triangle = [[(0.2, 0.2), (0.6, 0.2), (0.2, 0.6), (0.2, 0.2)]]
    areas = spark.createDataFrame(
        [(k, triangle, 0.2, 0.2, 0.6, 0.6) for k in range(100)], f"area long, {RINGS}, {BOUNDS}")
    boxes = spark.createDataFrame([(k, 0.1, 0.1, 0.3, 0.3) for k in range(1000)], f"box long, {BOUNDS}")
    found = scenes.meeting_pairs(boxes, areas, ["area"], limit=limit).select("area", "box").collect()
    assert len(found) == len(set(found)) == 100_000
    assert 0 < compared.value < 500


@pytest.mark.parametrize("limit", [0, scenes.BROADCAST_ROWS])
@pytest.mark.parametrize("rings", [None, "rings"])
def test_every_row_of_a_shape_is_paired(spark, monkeypatch, rings, limit):
    """Copies of rows and keys, lists that are full, bounds that are missing, columns named alike on both sides."""
    monkeypatch.setattr(scenes, "LISTED", 3)
    monkeypatch.setattr(scenes, "LISTED_KEYS", 2)

    def square(x, y, side):
        return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]], x, y, x + side, y + side

    areas = [(f"a{k % 12}", "area", *square(*((0.25, 0.25, 1.5), (5.5, 5.5, 0.25), (-3.0, -3.0, 0.5))[k % 3]))
             for k in range(20)] + [("none", "area", None, None, None, None, None)]
    boxes = [(k % 25, "box", *square(*((-0.0, 0.0, 0.5), (1.5, 1.0, 2.0), (5.0, 5.0, 1.0), (9.0, 9.0, 1.0))[k % 4]))
             for k in range(40)] + [(99, "box", None, None, 0.0, 1.0, 1.0)]
    expected = sorted(
        (a[0], b[0], b[3]) for a in areas for b in boxes if None not in (*a[2:], *b[2:])
        and a[3] <= b[5] and a[5] >= b[3] and a[4] <= b[6] and a[6] >= b[4])
    pairs = scenes.meeting_pairs(
        spark.createDataFrame(boxes, f"box long, name string, {RINGS}, {BOUNDS}"),
        spark.createDataFrame(areas, f"area string, name string, {RINGS}, {BOUNDS}"),
        ["area", "name"], rings, limit=limit)
    assert pairs.columns == ["area", "name", "box", "rings", "minx", "miny", "maxx", "maxy"]
    rows = pairs.collect()
    assert sorted((r["area"], r["box"], r["minx"]) for r in rows) == expected
    assert {r["name"] for r in rows} == {"area"} and {str(r["minx"]) for r in rows} == {"-0.0", "1.5", "5.0"}
    few = scenes.meeting_pairs(
        spark.createDataFrame(boxes, f"box long, name string, {RINGS}, {BOUNDS}"),
        spark.createDataFrame(areas, f"area string, name string, {RINGS}, {BOUNDS}"),
        ["area"], rings, limit=limit, columns=["box"])
    assert few.columns == ["area", "box"]
    assert sorted(tuple(r) for r in few.collect()) == [e[:2] for e in expected]


def test_rows_of_a_crowded_shape_go_to_several_tasks(spark):
    """20,000 footprints of one place in a single file are paired by several tasks."""
    boxes = spark.createDataFrame([(k, 0.1, 0.1, 0.3, 0.3) for k in range(20_000)], f"box long, {BOUNDS}").coalesce(1)
    ring = [[(0.2, 0.2), (0.6, 0.2), (0.2, 0.6), (0.2, 0.2)]]
    areas = spark.createDataFrame([(k, ring, 0.2, 0.2, 0.6, 0.6) for k in range(3)], f"area long, {RINGS}, {BOUNDS}")
    found = scenes.meeting_pairs(boxes, areas, ["area"], columns=["box"])
    by_task = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in by_task) == 60_000
    assert len(by_task) > 3 and max(r["count"] for r in by_task) < 40_000
