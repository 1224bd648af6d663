"""What the plans must look like: shuffles, pushed filters, reuse, no nested loops."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from charscape.operators import catalog, composite, grids, layers, scenes, spatial, zonal
from charscape.plans import queries, vegetation
from charscape.sources import readers, sinks, tables
from charscape.sources.workspace import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after running, without the initial plans of its parts."""
    plan = df._jdf.queryExecution()
    df._jdf.collect()
    kept, dropping = [], None
    for line in plan.executedPlan().toString().splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if dropping is not None and indent >= dropping:
            continue
        dropping = indent if "== Initial Plan ==" in line else None
        if dropping is None:
            kept.append(line)
    return "\n".join(kept)


def exchanges(plan: str) -> int:
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single)", plan))


def test_composite_has_one_shuffle_and_partial_medians(spark):
    plan = initial_plan(queries.indices(spark, SF))
    assert exchanges(plan) == 1
    assert "partial_percentile" in plan
    assert "PythonUDF" not in plan and "ArrowEval" not in plan


def test_scan_reads_only_needed_columns_and_pushes_the_window(spark):
    plan = initial_plan(queries.indices(spark, SF))
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert schema.count(":") == 4


@pytest.mark.parametrize("broadcast_bytes", [0, spatial.BROADCAST_BYTES])
def test_polygon_join_is_an_equi_join(spark, broadcast_bytes):
    df = spatial.zone_pixel_join(
        queries.pixel_grid(spark, SF), tables.zones(spark, SF), broadcast_bytes=broadcast_bytes
    )
    plan = initial_plan(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert re.search(r"Join \[cell_r#\d+L, cell_c#\d+L\]", plan)


def test_dissolve_after_shuffled_join_stays_in_place(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spatial.zone_pixel_join(
            queries.pixel_grid(spark, SF), tables.zones(spark, SF), broadcast_bytes=0
        )
        assert exchanges(initial_plan(zonal.dissolve(pairs))) == exchanges(initial_plan(pairs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_matrix_scans_observations_once(spark):
    plan = final_plan(queries.matrix(spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_partkey", plan)) == 1
    assert plan.count("partial_percentile(") == 4
    assert "ReusedExchange" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pyramid_reuses_each_level(spark):
    plan = final_plan(grids.overview_pyramid(queries.indices(spark, SF), 3))
    assert plan.count("ReusedExchange") == 2


def test_regrid_has_no_shuffle_of_its_own(spark):
    grid = queries.pixel_grid(spark, SF).withColumn("rbr", F.lit(0.5))
    assert exchanges(initial_plan(grids.regrid_nearest(grid, tables.LONLAT, tables.UTM))) == 0


def test_newest_item_is_limited_before_the_shuffle(spark):
    plan = initial_plan(catalog.latest_items(tables.items(spark, SF)))
    before = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_item_search_prunes_partitions_and_pushes_filters(spark):
    path = new_path(spark, "items")
    sinks.append_items(tables.items(spark, SF), path)
    found = catalog.search_items(
        readers.read_items(spark, path), "event7", "fire_severity", (-119, 33, -118, 34),
        "1996-01-01", "1997-01-01",
    ).select("id")
    plan = initial_plan(found)
    assert re.search(r"PartitionFilters: \[[^\]]*fire_event_name#\d+ = event7", plan)
    for pushed in (
        "EqualTo(product_type,fire_severity)",
        "LessThanOrEqual(minx,-118.0)",
        "GreaterThanOrEqual(datetime,1996-01-01",
    ):
        assert pushed in plan
    assert found.count() > 0


def test_items_are_validated_once(spark):
    """The filter on valid items does not repeat the checks, nor the building of what they look at."""
    built = catalog.boundary_items(queries.job_rows(spark, SF), "https://catalog.example")
    good = catalog.validate_items(built).where("is_valid").select(*built.columns)
    assert good._jdf.queryExecution().optimizedPlan().toString().lower().count("bbox inverted") == 1


def test_observation_scan_prunes_bands_and_pushes_the_box(spark):
    path = new_path(spark, "observations")
    sinks.write_observations(
        tables.observations(spark, SF).select(
            "scene_id", "ts", "band", "tile_id", "row", "col", "x", "y", "value"
        ),
        path,
    )
    stored = readers.read_observations(spark, path)
    plan = initial_plan(composite.scan_observations(stored, queries.SCAN_BOX, tables.PRE))
    assert re.search(r"PartitionFilters: \[[^\]]*band#\d+ IN \(B12,B8A\)", plan)
    assert "GreaterThanOrEqual(x,-116.4985)" in plan and "LessThanOrEqual(y,33.8071)" in plan
    assert stored.count() == tables.observations(spark, SF).count()


def test_job_lookups_reduce_items_before_the_join(spark):
    plan = initial_plan(
        catalog.pending_jobs(
            tables.requests(spark, SF), tables.items(spark, SF), catalog.MATRIX_JOB
        )
    )
    assert "LeftAnti" in plan and "NestedLoop" not in plan
    anti_side = plan[plan.index("LeftAnti") :]
    assert len(re.findall(r"HashAggregate\(keys=\[fire_event_name#\d+, job_id#\d+\]", anti_side)) >= 2


def test_grid_writer_evaluates_its_input_once(spark):
    """No range sampling: the composite's scan runs in one stage of one job."""
    path = new_path(spark, "grid")
    grid = queries.indices(spark, SF).withColumns(
        {"fire_event_name": F.lit("e"), "job_id": F.lit("j")})
    seen = spark.sparkContext.accumulator(0)
    counted = grid.mapInPandas(lambda parts: _counted(parts, seen), grid.schema)
    sinks.write_index_grid(counted, path, composite.INDICES)
    stored = readers.read_job_grids(spark, path)
    assert seen.value == stored.count() > 0


def _counted(parts, seen):
    for part in parts:
        seen.add(len(part))
        yield part


@pytest.mark.parametrize("broadcast_bytes", [0, spatial.BROADCAST_BYTES])
def test_rasterizing_reads_the_spine_once(spark, broadcast_bytes):
    spine = queries.pixel_grid(spark, SF)
    zones = tables.zones(spark, SF).withColumn("order", F.col("zone_id"))
    df = spatial.rasterize_zones(
        spine, zones, "zone_id", order="order", broadcast_bytes=broadcast_bytes)
    plan = initial_plan(df)
    assert len(re.findall(r"FileScan parquet \[p_partkey", plan)) == 1
    assert "NestedLoop" not in plan
    above_spine = plan[: plan.index("FileScan parquet [p_partkey")]
    assert exchanges(above_spine) <= 2


def test_footprints_and_areas_meet_by_an_equi_join(spark):
    for limit in (0, 10**6):
        pairs = scenes.search_scenes_of_jobs(
            tables.scenes(spark, SF), tables.search_areas(spark, SF), limit=limit)
        plan = initial_plan(pairs)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert re.search(r"Join \[cover_x#\d+L, cover_y#\d+L\]", plan)
        assert "EqualTo(event_type" in plan or "event_type#" in plan


def test_a_layer_is_cut_once_for_all_jobs(spark):
    layer = layers.cut_layer(tables.lonlat_zones(spark, SF), tables.UTM, 11, tables.CELL)
    grid = tables.job_grids(queries.indices(spark, SF).select("row", "col", "rbr"))
    table = vegetation.projected_matrices(
        layer, grid, grid.select("fire_event_name", "job_id"), tables.LONLAT, tables.UTM)
    plan = initial_plan(table)
    assert plan.count("bit_xor(filled") == plan.count("partial_bit_xor(filled") + 1 or plan.count(
        " bit_xor(filled") <= 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan
