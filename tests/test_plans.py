"""Whole jobs over small tables: severity, refinement, vegetation matrix, status."""

from __future__ import annotations

import json
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from charscape.operators import catalog, zonal
from charscape.operators.grids import GridGeometry, project_zones, regrid_nearest
from charscape.operators.layers import cut_layer, layer_matrix
from charscape.operators.requests import check_requests, job_observations
from charscape.operators.scenes import search_scenes_of_jobs
from charscape.operators.spatial import zones_in_grid_space
from charscape.plans import burn_severity, refinement, vegetation
from charscape.plans.store import Store
from charscape.schemas import ITEMS, REQUESTS
from charscape.sources import readers, sinks, tables
from charscape.sources.workspace import new_path

GRID = GridGeometry(10.0, 50.0, 0.01, -0.01)
NOW = "2024-05-01T12:00:00"
DAYS = [f"2023-{m:02d}-15" for m in range(1, 13)]


def box(minx, miny, maxx, maxy):
    ring = [[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]]
    return {"type": "Polygon", "coordinates": [ring]}


def request(job, geometry, event="ridge", windows=None):
    windows = windows or ("2023-01-01", "2023-06-30", "2023-07-01", "2023-12-31")
    text = geometry if isinstance(geometry, str) else json.dumps(geometry)
    return (job, event, text, *windows)


REQUESTED = [
    request("007", box(10.02, 49.92, 10.07, 49.97)),
    request("b", {"type": "Feature", "geometry": box(10.10, 49.85, 10.18, 49.95)}),
    request("nowhere", box(70, 10, 71, 11)),
    request("torn", '{"type": "Polygon", "coord'),
    request("undated", box(10, 49, 11, 50), windows=("2023-13-45", "2023-06-30", "2023-07-01", "2023-12-31")),
    request("windowless", box(10, 49, 11, 50), windows=(None, None, "2023-07-01", "2023-12-31")),
]


@pytest.fixture(scope="module")
def observations(spark):
    """A 20 x 20 grid with two bands in twelve months; values fall after the fire."""
    return (
        spark.range(400)
        .select(F.expr("id div 20").alias("row"), (F.col("id") % 20).alias("col"))
        .withColumn("band", F.explode(F.array(F.lit("B8A"), F.lit("B12"), F.lit("B04"))))
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
        .select(
            F.concat_ws("-", "band", "month").alias("scene_id"),
            F.make_timestamp_ntz(
                F.lit(2023), F.col("month"), F.lit(15), F.lit(0), F.lit(0), F.lit(0)
            ).alias("ts"),
            "band",
            F.expr("(row div 8) * 1000 + col div 8").alias("tile_id"),
            "row",
            "col",
            (F.lit(10.0) + (F.col("col") + 0.5) * 0.01).alias("x"),
            (F.lit(50.0) - (F.col("row") + 0.5) * 0.01).alias("y"),
            F.when(F.col("band") == "B8A", F.when(F.col("month") < 7, 60.0).otherwise(20.0))
            .otherwise(F.when(F.col("month") < 7, 20.0).otherwise(20.0 + F.col("col")))
            .cast("double")
            .alias("value"),
        )
    )


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(REQUESTED, REQUESTS)


def expected_rbr(col: int) -> float:
    pre, post = 40.0 / 80.0, -col / (40.0 + col)
    return (pre - post) / (pre + 1.001)


def pixels_in(minx, miny, maxx, maxy):
    """Pixels whose centre is in the box after growing it by a fifth per side."""
    dx, dy = (maxx - minx) * 0.2, (maxy - miny) * 0.2
    return {
        (r, c)
        for r in range(20)
        for c in range(20)
        if minx - dx <= 10 + (c + 0.5) * 0.01 <= maxx + dx
        and miny - dy <= 50 - (r + 0.5) * 0.01 <= maxy + dy
    }


def test_requests_are_checked(requests):
    got = {r["job_id"]: (r["status"], r["reason"]) for r in check_requests(requests).collect()}
    assert got["007"] == ("ready", None) and got["b"] == ("ready", None)
    assert got["torn"] == ("error", "malformed json")
    assert got["windowless"] == ("error", "both date windows are required")


@pytest.mark.parametrize("limit", [0, 1000])
def test_jobs_read_their_own_box(requests, observations, limit):
    got = job_observations(observations, check_requests(requests), limit=limit)
    rows = got.select("job_id", "row", "col", "band", "ts").collect()
    assert len(rows) == len(set(rows))
    for job, bounds in (("007", (10.02, 49.92, 10.07, 49.97)), ("b", (10.10, 49.85, 10.18, 49.95))):
        assert {(r["row"], r["col"]) for r in rows if r["job_id"] == job} == pixels_in(*bounds)
        assert {r["band"] for r in rows if r["job_id"] == job} == {"B8A", "B12"}
    assert {r["job_id"] for r in rows} == {"007", "b"}


@pytest.fixture(scope="module")
def finished(spark, requests, observations):
    store = Store(new_path(spark, "store"), "https://store.example", "https://catalog.example")
    analysis = burn_severity.analyze(spark, observations, requests, store, NOW, ingest_seq=1)
    analysed = {r["job_id"]: r["status"] for r in analysis.collect()}
    polygons = spark.createDataFrame(
        [
            ("007", "ridge", json.dumps(box(10.031, 49.931, 10.049, 49.949))),
            ("ghost", "ridge", json.dumps(box(10.03, 49.93, 10.05, 49.95))),
        ],
        "job_id string, fire_event_name string, geometry string",
    )
    later = "2024-05-02T12:00:00"
    refined = refinement.refine(spark, polygons, store, GRID, later, ingest_seq=2)
    refinements = {r["job_id"]: (r["status"], r["reason"]) for r in refined.collect()}
    zones = spark.createDataFrame(
        [
            ("007", "ridge", 1, "oak", [[(2.5, 4.5), (4.5, 4.5), (4.5, 7.5), (2.5, 7.5), (2.5, 4.5)]]),
            ("007", "ridge", 2, "pine", [[(15.5, 15.5), (16.5, 15.5), (16.5, 16.5), (15.5, 15.5)]]),
        ],
        "job_id string, fire_event_name string, zone_id long, veg_type string, rings array<array<struct<x:double,y:double>>>",
    )
    jobs = polygons.select("job_id", "fire_event_name")
    resolved = vegetation.resolve(spark, jobs, zones, store, 0.04, 400.0, ingest_seq=3)
    return store, analysed, refinements, {r["job_id"]: r for r in resolved.collect()}


def test_severity_job(spark, finished):
    store, analysed, _, _ = finished
    assert analysed == {
        "007": "completed",
        "b": "completed",
        "nowhere": "failed_validation",
        "torn": "error: malformed json",
        "windowless": "error: both date windows are required",
        "undated": "error: malformed date",
    }
    grid = readers.read_job_grids(spark, store.coarse_grids)
    rows = grid.where("job_id = '007'").collect()
    assert {(r["row"], r["col"]) for r in rows} == pixels_in(10.02, 49.92, 10.07, 49.97)
    for r in rows:
        assert r["rbr"] == pytest.approx(expected_rbr(r["col"]), rel=1e-6)


def test_catalogue_after_all_jobs(spark, finished):
    store = finished[0]
    items = readers.read_items(spark, store.items)
    got = sorted((r["id"], r["boundary_type"] or "") for r in items.collect())
    assert got == [
        ("ridge-boundary-007", "coarse"),
        ("ridge-boundary-007", "refined"),
        ("ridge-boundary-b", "coarse"),
        ("ridge-severity-007", "coarse"),
        ("ridge-severity-007", "refined"),
        ("ridge-severity-b", "coarse"),
        ("ridge-veg-matrix-007", ""),
    ]
    refined = catalog.item_by_id(items, "ridge-severity-007", "refined").first()
    matrix = catalog.item_by_id(items, "ridge-veg-matrix-007").first()
    coarse = catalog.item_by_id(items, "ridge-severity-007", "coarse").first()
    assert matrix["geometry"] == refined["geometry"] != coarse["geometry"]
    assert matrix["datetime"] == refined["datetime"] == coarse["datetime"]
    boundary = catalog.item_by_id(items, "ridge-boundary-007", "refined").first()
    assert str(boundary["datetime"]) == "2024-05-02 12:00:00"
    assert boundary["assets"]["refined_boundary"]["title"] == "Refined Fire Boundary"
    assert [link["rel"] for link in boundary["links"]] == ["self", "collection", "root", "related"]
    assert json.loads(coarse["geometry"]) == box(10.02, 49.92, 10.07, 49.97)


def test_refined_grid_is_clipped(spark, finished):
    store, _, refinements, _ = finished
    assert refinements == {"007": ("completed", None), "ghost": ("error", "original grid not found")}
    grid = readers.read_job_grids(spark, store.refined_grids).collect()
    assert {(r["row"], r["col"]) for r in grid} == {(r, c) for r in (5, 6) for c in (3, 4)}


def test_matrix_of_the_job(spark, finished):
    store, _, _, resolved = finished
    assert resolved["007"]["status"] == "complete"
    assert re.fullmatch(
        r"https://store.example/matrices/fire_event_name=ridge/job_id=007/part-[^/]*\.csv",
        resolved["007"]["fire_veg_matrix"])
    assert resolved["ghost"]["status"] == "pending"
    rows = (
        spark.read.option("header", True)
        .csv(f"{store.matrices}/fire_event_name=ridge/job_id=007")
        .orderBy("Vegetation Community")
        .collect()
    )
    oak, pine = rows
    assert (oak["Vegetation Community"], oak["Hectares"], oak["% of Burn Area"]) == (
        "oak",
        "0.24",
        "100.0",
    )
    assert (pine["Vegetation Community"], pine["Mean Severity"], pine["% of Burn Area"]) == (
        "pine",
        "0.0",
        "0.0",
    )


def test_every_address_of_a_finished_job_opens(spark, finished):
    """Below the store's root lies what the media type says."""
    store = finished[0]
    assets = readers.read_items(spark, store.items).select(
        "product_type", F.explode("assets").alias("name", "asset")).collect()
    assert len(assets) >= 10
    root = store.root.split(":", 1)[-1]
    for row in assets:
        href, kind = row["asset"]["href"], row["asset"]["type"]
        place = pathlib.Path("/" + root.strip("/")) / href.removeprefix("https://store.example/")
        if kind == "application/vnd.apache.parquet":
            assert place.is_dir() and spark.read.parquet(str(place)).count() > 0
        elif kind == "application/geo+json":
            assert json.loads(place.read_text())["type"] == "FeatureCollection"
        else:
            assert kind == "text/csv" and place.read_text().startswith("Color,")
    listed = readers.read_manifest(spark, store.manifest)
    assert listed.where("files < 1 or bytes <= 0 or media_type is null").count() == 0


def test_job_status_lookups(spark, finished, requests):
    items = readers.read_items(spark, finished[0].items)
    status = catalog.job_status(requests, items, catalog.SEVERITY_JOB).collect()
    assert {r["job_id"] for r in status if r["status"] == "complete"} == {"007", "b"}
    assert {r["cog_url"] for r in status if r["job_id"] == "b"} == {
        "https://store.example/grids/coarse/fire_event_name=ridge/job_id=b"
    }
    pending = catalog.pending_jobs(requests, items, catalog.REFINE_JOB).collect()
    assert "007" not in {r["job_id"] for r in pending} and len(pending) == 5


def test_rerun_replaces_grids_and_appends_items(spark, requests, observations):
    store = Store(new_path(spark, "store"), "https://store.example", "https://catalog.example")
    only = requests.where("job_id = '007'")
    for attempt in (1, 2):
        burn_severity.analyze(spark, observations, only, store, NOW, ingest_seq=attempt).collect()
    grid = readers.read_job_grids(spark, store.coarse_grids)
    assert grid.count() == grid.select("row", "col").distinct().count()
    items = readers.read_items(spark, store.items)
    assert items.count() == 4
    assert [r["ingest_seq"] for r in catalog.latest_items(items).collect()] == [2, 2]


def test_a_rerun_without_pixels_clears_the_grid(spark, requests, observations):
    store = Store(new_path(spark, "store"), "https://store.example", "https://catalog.example")
    only = requests.where("job_id = '007'")
    burn_severity.analyze(spark, observations, only, store, NOW, ingest_seq=1).collect()
    moved = only.withColumn("geometry", F.lit(json.dumps(box(70, 10, 71, 11))))
    again = burn_severity.analyze(spark, observations, moved, store, NOW, ingest_seq=2)
    assert [r["status"] for r in again.collect()] == ["failed_validation"]
    assert readers.read_job_grids(spark, store.coarse_grids).count() == 0
    assert readers.read_items(spark, store.items).count() == 2


def test_events_with_one_job_id_stay_apart(spark, observations):
    store = Store(new_path(spark, "store"), "https://store.example", "https://catalog.example")
    areas = {"ridge": (10.02, 49.92, 10.07, 49.97), "creek": (10.10, 49.85, 10.18, 49.95)}
    asked = spark.createDataFrame(
        [request("1", box(*bounds), event=event) for event, bounds in areas.items()], REQUESTS
    )
    done = burn_severity.analyze(spark, observations, asked, store, NOW, ingest_seq=1).collect()
    assert {(r["fire_event_name"], r["status"]) for r in done} == {
        ("ridge", "completed"), ("creek", "completed")
    }
    grid = readers.read_job_grids(spark, store.coarse_grids).collect()
    for event, bounds in areas.items():
        assert {(r["row"], r["col"]) for r in grid if r["fire_event_name"] == event} == pixels_in(*bounds)
    clips = spark.createDataFrame(
        [("1", "ridge", json.dumps(box(10.031, 49.931, 10.049, 49.949))),
         ("1", "creek", json.dumps(box(70, 10, 71, 11)))],
        "job_id string, fire_event_name string, geometry string",
    )
    refined = refinement.refine(spark, clips, store, GRID, NOW, ingest_seq=2).collect()
    assert {(r["fire_event_name"], r["status"]) for r in refined} == {
        ("ridge", "completed"), ("creek", "failed_validation")
    }
    items = readers.read_items(spark, store.items)
    kinds = {(r["fire_event_name"], r["boundary_type"]) for r in items.collect()}
    assert kinds == {("ridge", "coarse"), ("creek", "coarse"), ("ridge", "refined")}
    ring = [(2.5, 4.5), (4.5, 4.5), (4.5, 7.5), (2.5, 7.5), (2.5, 4.5)]
    zones = spark.createDataFrame(
        [("1", "ridge", 1, "oak", [ring]), ("1", "creek", 2, "pine", [ring])],
        "job_id string, fire_event_name string, zone_id long, veg_type string, "
        "rings array<array<struct<x:double,y:double>>>",
    )
    jobs = clips.select("job_id", "fire_event_name")
    got = vegetation.resolve(spark, jobs, zones, store, 0.04, 400.0, ingest_seq=3).collect()
    assert {(r["fire_event_name"], r["status"]) for r in got} == {
        ("ridge", "complete"), ("creek", "pending")
    }


def test_job_scan_is_bounded(spark, requests, observations):
    path = new_path(spark, "observations")
    sinks.write_observations(observations, path)
    stored = readers.read_observations(spark, path)
    one = check_requests(requests.where("job_id = '007'"))
    fields = "spark.sql.debug.maxToStringFields"
    spark.conf.set(fields, "200")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = job_observations(stored, one)._jdf.queryExecution().sparkPlan().toString()
    spark.conf.unset(fields)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(x," in pushed and "LessThanOrEqual(y," in pushed
    assert "GreaterThanOrEqual(ts,2023-01-01" in pushed
    assert "month" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    scenes = spark.createDataFrame([("B8A-1",), ("B8A-8",)], "scene_id string")
    rows = job_observations(stored, one, scenes=scenes).select("band", "ts").distinct().collect()
    assert {(r["band"], r["ts"].month) for r in rows} == {("B8A", 1), ("B8A", 8)}


def test_distant_fires_read_only_their_areas(spark):
    """Two fires at opposite corners: files of all other areas cannot even be read."""
    path = new_path(spark, "observations")
    spots = spark.range(24 * 24).select(
        F.expr("id div 24").alias("row"), (F.col("id") % 24).alias("col"))
    sinks.write_observations(spots.select(
        F.lit("s").alias("scene_id"), F.lit("2023-03-01").cast("timestamp_ntz").alias("ts"),
        F.explode(F.array(F.lit("B8A"), F.lit("B12"))).alias("band"), F.lit(0).cast("long").alias("tile_id"),
        "row", "col", (10.0 + F.col("col") * 0.125).alias("x"), (50.0 + F.col("row") * 0.125).alias("y"),
        F.lit(1.0).alias("value")), path)
    asked = spark.createDataFrame(
        [request("sw", box(10.1, 50.1, 10.3, 50.3)), request("ne", box(12.6, 52.6, 12.8, 52.8))], REQUESTS)
    stored = readers.read_observations(spark, path)
    at = F.substring_index(F.col("_metadata.file_path"), "/part-", 1)
    folders = {r[0] for r in stored.select(at).distinct().collect()}
    near = (F.col("x").between(10.0, 10.4) & F.col("y").between(50.0, 50.4)) | (
        F.col("x").between(12.5, 12.9) & F.col("y").between(52.5, 52.9))
    kept = {r[0] for r in stored.where(near).select(at).distinct().collect()}
    assert len(kept) == 4 and len(folders) > 40
    for folder in folders - kept:
        spark.createDataFrame([("no parquet",)], "value string").write.mode("append").text(folder)
    found = job_observations(readers.read_observations(spark, path), check_requests(asked))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    rows = found.select("job_id", "row", "col").distinct().collect()
    assert {(r["job_id"], r["row"], r["col"]) for r in rows} == {
        *(("sw", r, c) for r in (1, 2) for c in (1, 2)), *(("ne", r, c) for r in (21, 22) for c in (21, 22))}
    with pytest.raises(Exception):
        readers.read_observations(spark, path).agg(F.sum("value")).collect()


def test_observations_make_a_bounded_number_of_folders(spark):
    """A wide region is stored in larger areas; jobs read it together with small areas of another write."""
    path = new_path(spark, "observations")
    spots = spark.range(24 * 24).select(
        F.lit("s").alias("scene_id"), F.lit("2023-03-01").cast("timestamp_ntz").alias("ts"),
        F.explode(F.array(F.lit("B8A"), F.lit("B12"))).alias("band"), F.lit(0).cast("long").alias("tile_id"),
        F.expr("id div 24").alias("row"), (F.col("id") % 24).alias("col"),
        (10.0 + F.col("id") % 24 * 0.125).alias("x"), (50.0 + F.expr("id div 24") * 0.125).alias("y"),
        F.lit(1.0).alias("value"))
    folder = F.substring_index(F.col("_metadata.file_path"), "/part-", 1)
    sinks.write_observations(spots, path, folders=30)
    assert 2 < readers.read_observations(spark, path).select(folder).distinct().count() <= 30
    sinks.write_observations(spots, path)
    assert readers.read_observations(spark, path).select(folder).distinct().count() > 72
    asked = spark.createDataFrame(
        [request("sw", box(10.1, 50.1, 10.3, 50.3)), request("ne", box(12.6, 52.6, 12.8, 52.8))], REQUESTS)
    found = job_observations(readers.read_observations(spark, path), check_requests(asked))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.groupBy("job_id", "band", "row", "col").count().collect()
    assert {(r["job_id"], r["row"], r["col"]) for r in rows} == {
        *(("sw", r, c) for r in (1, 2) for c in (1, 2)), *(("ne", r, c) for r in (21, 22) for c in (21, 22))}
    assert len(rows) == 16 and {r["count"] for r in rows} == {2}


def test_each_job_reads_its_own_scenes(spark, requests, observations):
    """Two footprints, each over one of the jobs, and one of another collection."""
    table = spark.createDataFrame(
        [("B8A-1", "sentinel-2-l2a", 1, 10.0, 49.9, 10.075, 50.0), ("B12-1", "sentinel-2-l2a", 1, 10.095, 49.8, 10.2, 49.96),
         ("B8A-8", "sentinel-2-l2a", 8, 9.0, 49.0, 11.0, 51.0), ("B12-8", "other", 8, 9.0, 49.0, 11.0, 51.0),
         ("B8A-9", "sentinel-2-l2a", 1, 30.0, 49.0, 31.0, 51.0)],
        "scene_id string, collection string, month int, minx double, miny double, maxx double, maxy double",
    ).withColumn("ts", F.make_timestamp_ntz(F.lit(2023), "month", F.lit(15), F.lit(0), F.lit(0), F.lit(0)))
    checked = check_requests(requests)
    wanted = checked.where("status = 'ready'").select(
        "fire_event_name", "job_id", "rings", "minx", "miny", "maxx", "maxy",
        F.col("pre_start").alias("first"), F.col("post_end").alias("last"))
    own = search_scenes_of_jobs(table, wanted)
    assert {(r["job_id"], r["scene_id"]) for r in own.collect()} == {
        ("007", "B8A-1"), ("007", "B8A-8"), ("b", "B12-1"), ("b", "B8A-8")}
    rows = job_observations(observations, checked, scenes=own.select("fire_event_name", "job_id", "scene_id"))
    got = {(r["job_id"], r["band"], r["ts"].month) for r in rows.collect()}
    assert got == {("007", "B8A", 1), ("007", "B8A", 8), ("b", "B12", 1), ("b", "B8A", 8)}
    # A whole job searches for itself.
    indices = burn_severity.job_indices(observations, checked, table)
    assert {r["job_id"] for r in indices.select("job_id").distinct().collect()} == {"007", "b"}


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 25])
def test_jobs_over_one_layer(spark, broadcast_bytes):
    """The matrix of each job equals the one of its own grid and zones."""
    sf = "/root/testdata/sf0.001"
    zones = tables.lonlat_zones(spark, sf)
    path = new_path(spark, "layer")
    sinks.write_zone_layer(cut_layer(zones, tables.UTM, 11, 8), path)
    layer = readers.read_zone_layer(spark, path)
    assert layer.cell == 8
    source = spark.range(50 * 4).select(F.expr("id div 50").alias("row"), (F.col("id") % 50).alias("col"),
                                        (F.col("id") % 11 / 10.0).alias("rbr"))
    grid = tables.job_grids(source)
    projected = regrid_nearest(grid, tables.LONLAT, tables.UTM, ["rbr"], by=("fire_event_name", "job_id")).cache()
    assert projected.where("tile_id = floor(row / 16) * 1000 + floor(col / 16)").count() == projected.count() > 0
    jobs = spark.createDataFrame([("event1", str(j)) for j in range(4)], "fire_event_name string, job_id string")
    got = layer_matrix(layer, projected, jobs, 0.04, ["fire_event_name", "job_id"],
                       broadcast_bytes=broadcast_bytes).collect()
    metric = project_zones(zones, 11)
    placed = zones_in_grid_space(metric, 546000.0, 3739000.0, 20.0, 20.0)
    for job in range(4):
        own = zonal.veg_fire_matrix(
            projected.where(F.col("job_id") == str(job)), placed, 0.04, 400.0).collect()
        left = {r["veg_type"]: (r["low_ha"], r["high_ha"], r["total_ha"], r["mean_severity"]) for r in own}
        right = {r["veg_type"]: (r["low_ha"], r["high_ha"], r["total_ha"], r["mean_severity"])
                 for r in got if r["job_id"] == str(job)}
        assert left.keys() == right.keys()
        for kind in left:
            assert left[kind] == pytest.approx(right[kind], rel=1e-9)


def test_projected_job_is_published(spark, finished):
    """A finished refinement over a stored layer: grid in longitude and latitude to a CSV and an item."""
    store, _, _, _ = finished
    ring = [(10.02, 49.92), (10.05, 49.92), (10.05, 49.95), (10.02, 49.95), (10.02, 49.92)]
    zones = spark.createDataFrame([(1, "oak", [ring])], "zone_id long, veg_type string, "
                                  "rings array<array<struct<x:double,y:double>>>")
    target = GridGeometry(200000.0, 5500000.0, 500.0, 500.0)
    path = new_path(spark, "layer")
    sinks.write_zone_layer(cut_layer(zones, target, 32), path)
    other = Store(store.root, "https://store.example", "https://catalog.example")
    asked = spark.createDataFrame([("007", "ridge")], "job_id string, fire_event_name string")
    got = vegetation.resolve_over_layer(
        spark, asked, path, other, GRID, target, 32, ingest_seq=9).collect()
    assert [r["status"] for r in got] == ["complete"]
    (oak,) = spark.read.option("header", True).csv(
        f"{store.matrices}/fire_event_name=ridge/job_id=007").collect()
    # 0.03 by 0.03 degrees at 49.9 degrees north.
    assert float(oak["Hectares"]) == pytest.approx(718, rel=0.01)
    assert oak["Vegetation Community"] == "oak" and float(oak["Mean Severity"]) > 0


def test_uploaded_boundary(spark):
    store = Store(new_path(spark, "store"), "https://store.example", "https://catalog.example")
    rows = [
        ("u1", "ridge", json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "geometry": box(0, 0, 1, 1), "properties": {}}]})),
        ("u2", "ridge", json.dumps({"type": "Point", "coordinates": [1, 2]})),
    ]
    asked = spark.createDataFrame(rows, "job_id string, fire_event_name string, geometry string")
    got = {r["job_id"]: r for r in refinement.upload_boundaries(asked, store, NOW).collect()}
    assert got["u1"]["uploaded_geojson"].startswith(
        "https://store.example/boundaries/fire_event_name=ridge/job_id=u1/name=uploaded/part-")
    assert got["u2"]["uploaded_geojson"] is None
    assert got["u2"]["status"] == "error" and got["u2"]["reason"] == "not a polygon"
    lines = spark.read.text(store.boundaries).collect()
    assert json.loads(lines[0]["value"])["features"][0]["geometry"]["type"] == "Polygon"
    assert len(lines) == 1


def test_catalogue_is_empty_before_the_first_item(spark):
    items = readers.read_items(spark, new_path(spark, "never"))
    assert items.schema == ITEMS and items.count() == 0
    assert catalog.item_by_id(items, "x").count() == 0
