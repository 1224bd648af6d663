"""Properties of the matrix and hand-computed values."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from charscape.functions import geojson, geometry
from charscape.operators import spatial, zonal
from charscape.sources import readers
from charscape.sources.workspace import new_path

POLYGON = "zone_id long, veg_type string, rings array<array<struct<x:double,y:double>>>"


def rect(x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [[{"x": float(x), "y": float(y)} for x, y in ring]]


# Two overlapping polygons of one type, one without a type, one without pixels.
ZONES = [
    (1, "oak", rect(0.1, 0.1, 1.9, 1.9)),
    (2, "oak", rect(1.1, 0.1, 2.9, 1.9)),
    (3, None, rect(0.1, 2.1, 3.9, 2.9)),
    (4, "far", rect(90.1, 90.1, 91.9, 91.9)),
]
RBR = [
    [-0.2, -0.1, 0.0, 0.0999],
    [0.1, 0.2, 0.2699, 0.27],
    [0.5, 0.6599, 0.66, 0.9],
    [None, None, None, 0.3],
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, POLYGON)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(r, c, RBR[r][c]) for r in range(4) for c in range(4)]
    return spark.createDataFrame(rows, "row long, col long, rbr double")


def matrix(grid, zones, **options):
    table = zonal.veg_fire_matrix(grid, zones, 0.04, 400.0, **options)
    return {r["veg_type"]: r.asDict() for r in table.collect()}


def test_hand_computed_matrix(grid, zones):
    got = matrix(grid, zones)
    oak, none, far = got["oak"], got[None], got["far"]
    # The shared column counts once for pixels and twice for area.
    assert oak["unburned_ha"] == pytest.approx(0.08)
    assert oak["low_ha"] == pytest.approx(0.12)
    assert oak["moderate_ha"] == oak["high_ha"] == 0
    assert oak["total_ha"] == pytest.approx(2 * 1.8 * 1.8 * 0.04)
    assert none["moderate_ha"] == pytest.approx(0.08) and none["high_ha"] == pytest.approx(0.08)
    assert none["total_ha"] == pytest.approx(3.8 * 0.8 * 0.04)
    assert far["mean_severity"] == far["std_severity"] == far["pct_of_burn"] == 0
    assert oak["pct_of_burn"] == pytest.approx(0.12 / 0.28 * 100)
    mean = 0.12 * 0.185 / oak["total_ha"]
    assert oak["mean_severity"] == pytest.approx(mean)
    spread = 0.08 * mean**2 + 0.12 * (0.185 - mean) ** 2
    assert oak["std_severity"] == pytest.approx(math.sqrt(spread / oak["total_ha"]))


def test_value_sum_adds_values_instead_of_pixels(grid, zones):
    oak = matrix(grid, zones, measure="value_sum")["oak"]
    assert oak["low_ha"] == pytest.approx((0.1 + 0.2 + 0.2699) * 0.04)
    assert oak["unburned_ha"] == pytest.approx((-0.1 + 0.0) * 0.04)


def test_shares_sum_to_hundred(grid, zones):
    got = matrix(grid, zones).values()
    assert sum(r["pct_of_burn"] for r in got) == pytest.approx(100)
    assert sum(r["pct_of_park"] for r in got) == pytest.approx(100)


def test_order_and_partitions_do_not_matter(grid, zones):
    one = matrix(grid.coalesce(1), zones)
    many = matrix(grid.repartition(7).orderBy(F.rand(3)), zones.repartition(5), broadcast_bytes=0)
    assert one.keys() == many.keys()
    for kind, row in one.items():
        for name, value in row.items():
            assert many[kind][name] == (
                pytest.approx(value) if isinstance(value, float) else value
            )


def test_grouped_matrix_equals_single_matrices(grid, zones):
    both = grid.withColumn("job_id", F.lit("a")).unionByName(
        grid.withColumn("rbr", F.col("rbr") / 2).withColumn("job_id", F.lit("b"))
    )
    layers = zones.withColumn("job_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    table = zonal.veg_fire_matrix(both, layers, 0.04, 400.0, by=["job_id"]).collect()
    single = {"a": matrix(grid, zones), "b": matrix(grid.withColumn("rbr", F.col("rbr") / 2), zones)}
    assert len(table) == 6
    for row in table:
        for name, value in single[row["job_id"]][row["veg_type"]].items():
            assert row[name] == (pytest.approx(value) if isinstance(value, float) else value)


def test_presentation_rounds_half_even_and_names_columns(spark, grid, zones):
    shown = zonal.present(zonal.veg_fire_matrix(grid, zones, 0.04, 400.0))
    assert shown.columns == [
        "Color",
        "Vegetation Community",
        "Hectares",
        "% of Park",
        "% of Burn Area",
        "Mean Severity",
        "Std Dev",
    ]
    assert all(r["Color"].startswith("#") and len(r["Color"]) == 7 for r in shown.collect())
    ties = spark.createDataFrame([(0.125,), (0.375,)], "v double")
    assert [r[0] for r in ties.select(F.bround("v", 2)).collect()] == [0.12, 0.38]


def test_unknown_measure(grid, zones):
    with pytest.raises(ValueError):
        zonal.veg_fire_matrix(grid, zones, 0.04, 400.0, measure="pixels")


def test_negative_radicand_is_null(spark):
    df = spark.createDataFrame(
        [(-5.0, 0.0, 0.0, 1.0, 2.0)],
        "unburned_ha double, low_ha double, moderate_ha double, high_ha double, total_ha double",
    )
    assert zonal.with_severity(df).first()["std_severity"] is None


def test_midpoints_follow_breaks_on_request(spark):
    df = spark.createDataFrame(
        [(0.0, 1.0, 0.0, 0.0, 1.0)],
        "unburned_ha double, low_ha double, moderate_ha double, high_ha double, total_ha double",
    )
    assert zonal.with_severity(df).first()["mean_severity"] == 0.185
    assert zonal.with_severity(df, (0.5, 0.7)).first()["mean_severity"] == pytest.approx(0.3)


def test_zones_from_parquet_and_geojson_agree_after_projection(spark):
    ring = [{"x": x, "y": y} for x, y in ((-116.5, 33.8), (-116.49, 33.8), (-116.49, 33.81), (-116.5, 33.8))]
    layer = spark.createDataFrame(
        [(7, "oak", [ring])],
        "zone_id long, MapUnit_ID string, rings array<array<struct<x:double,y:double>>>",
    )
    parquet, lines = new_path(spark, "zones"), new_path(spark, "zones")
    layer.write.parquet(parquet)
    layer.select(
        geojson.feature_text(F.col("rings"), F.struct("zone_id", "MapUnit_ID")).alias("value")
    ).write.text(lines)
    one = readers.read_zones(spark, parquet, utm_zone=11).first()
    two = readers.read_geojson_zones(spark, lines, utm_zone=11).first()
    assert one["veg_type"] == two["veg_type"] == "oak" and one["rings"] == two["rings"]
    # About 0.01 degrees a side at this latitude.
    assert one["maxx"] - one["minx"] == pytest.approx(926, abs=15)
    assert one["maxy"] - one["miny"] == pytest.approx(1109, abs=15)
    assert zonal.zone_area(readers.read_zones(spark, parquet, utm_zone=11)).first()[
        "total_ha"
    ] == pytest.approx(926 * 1109 / 2 / 10000, rel=0.01)


def test_rejected_zone_line_raises(spark):
    path = new_path(spark, "zones")
    spark.createDataFrame([('{"type":"Feature","geometry":null}',)], "value string").write.text(path)
    with pytest.raises(Exception, match="not a polygon"):
        readers.read_geojson_zones(spark, path).collect()


def test_zones_of_several_parts(spark):
    def ring(x0, y0, x1, y1):
        return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]

    parts = [[ring(0, 0, 4, 4), ring(1, 1, 2, 2)], [ring(10, 10, 12, 12)]]
    lines = [
        {"type": "Feature", "properties": {"zone_id": 1, "MapUnit_ID": "oak"},
         "geometry": {"type": "MultiPolygon", "coordinates": parts}},
        {"type": "Feature", "properties": {"zone_id": 2, "MapUnit_ID": "ash"},
         "geometry": {"type": "Polygon", "coordinates": parts[0]}},
    ]
    path = new_path(spark, "zones")
    spark.createDataFrame([(json.dumps(f),) for f in lines], "value string").write.text(path)
    zones = readers.read_geojson_zones(spark, path)
    boxes = {r["zone_id"]: (r["minx"], r["miny"], r["maxx"], r["maxy"]) for r in zones.collect()}
    assert boxes == {1: (0, 0, 12, 12), 2: (0, 0, 4, 4)}
    areas = zones.select("zone_id", geometry.polygon_area(F.col("rings")).alias("a")).collect()
    assert {r["zone_id"]: r["a"] for r in areas} == {1: 19.0, 2: 15.0}
    pixels = spark.range(400).select(F.expr("id div 20").alias("row"), (F.col("id") % 20).alias("col"))
    found = spatial.zone_pixel_join(pixels, zones, all_touched=False, cell=4).collect()
    block = {(r, c) for r in range(4) for c in range(4)} - {(1, 1)}
    other = {(r, c) for r in (10, 11) for c in (10, 11)}
    assert {(r["row"], r["col"]) for r in found if r["zone_id"] == 1} == block | other
    assert {(r["row"], r["col"]) for r in found if r["zone_id"] == 2} == block
    # An area of interest stays a single polygon.
    asked = spark.createDataFrame([(json.dumps(lines[0]),)], "text string")
    assert geojson.parse_polygons(asked).first()["reason"] == "not a polygon"
