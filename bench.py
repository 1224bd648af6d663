"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 2)
BENCH_STACK    rows of a further, larger observation stack derived from lineitem (default 10000000,
               0 to leave it out)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.operators import composite, spatial
from charscape.plans import burn_severity
from charscape.plans.queries import QUERIES
from charscape.plans.store import Store
from charscape.schemas import REQUESTS
from charscape.session import BUILD_SETTINGS, SETTINGS
from charscape.sources import readers, sinks, tables

ZONE = "zone_id long, veg_type string, rings array<array<struct<x:double,y:double>>>"

HEADLINE = (
    "median_composite",
    "burn_indices",
    "severity_classify",
    "zone_pixel_join",
    "zone_pixel_join_center",
    "zonal_class_area",
    "veg_fire_matrix",
    "veg_fire_matrix_value_sum",
    "clip_grid",
    "regrid_nearest",
    "veg_fire_matrix_jobs",
    "scene_search_jobs",
    "overview_pyramid",
    "index_grid_sink",
    "scene_search",
    "items_search",
    "latest_item",
    "job_status",
    "related_items",
    "geojson_validate",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("charscape-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    if "SPARK_CHECKPOINT_DIR" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARK_CHECKPOINT_DIR"])
    for key, value in {**SETTINGS, **BUILD_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make, runs: int) -> float:
    run(make())
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run(make())
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 4)


def stack(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """Line items repeated on further pixels until the stack has about that many rows."""
    obs = tables.observations(spark, sf_dir)
    copies = max(1, -(-rows // obs.count()))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/stack"
    (
        obs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("row", F.col("row") + F.col("copy") * 100_000)
        .withColumn("tile_id", F.expr(f"(row div {tables.TILE}) * 1000 + col div {tables.TILE}"))
        .select("tile_id", "row", "col", "band", "ts", "value")
        .repartition(32)
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def severity_job(spark: SparkSession, obs: DataFrame) -> float:
    """Seconds of one whole job: stored observations to judged grid and catalogue items."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    grid = tables.LONLAT
    placed = obs.withColumns(
        {
            "scene_id": F.lit("bench"),
            "x": F.lit(grid.origin_x) + F.col("col") * grid.pixel_width,
            # The copies of the grid, end to end.
            "y": F.lit(grid.origin_y)
            + (F.col("row") % 100_000 + F.expr("row div 100000") * 400) * grid.pixel_height,
        }
    )
    sinks.write_observations(placed, f"{root}/observations")
    stored = readers.read_observations(spark, f"{root}/observations")
    low_x, low_y, high_x, high_y = stored.agg(
        F.min("x"), F.min("y"), F.max("x"), F.max("y")
    ).first()
    ring = [[low_x, low_y], [high_x, low_y], [high_x, high_y], [low_x, high_y], [low_x, low_y]]
    area = json.dumps({"type": "Polygon", "coordinates": [ring]})
    windows = (tables.PRE.start, tables.PRE.end, tables.POST.start, tables.POST.end)
    asked = spark.createDataFrame([("1", "bench", area, *windows)], REQUESTS)
    store = Store(f"{root}/store", "https://store.example", "https://catalog.example")
    start = time.perf_counter()
    burn_severity.analyze(spark, stored, asked, store, "2024-01-01", ingest_seq=1).collect()
    return round(time.perf_counter() - start, 4)


def comb_cells(spark: SparkSession, runs: int, edges: int = 32_000) -> float:
    """Seconds to cut one polygon whose edges all cross the same bands of cells."""
    points = []
    for i in range(edges // 2):
        points += [(0.3 + i / 4, 0.3), (0.4 + i / 4, 30.3)]
    ring = [*points, (points[-1][0], 40.0), (0.3, 40.0), points[0]]
    zone = spark.createDataFrame([(1, "x", [ring])], ZONE).cache()
    zone.count()
    return timed(lambda: spatial.polygon_cells(zone, ["zone_id"]), runs)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    rows = int(os.environ.get("BENCH_STACK", "10000000"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        seconds[name] = timed(lambda: QUERIES[name](spark, sf_dir), runs)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    if rows:
        obs = stack(spark, sf_dir, rows)
        count = obs.count()
        seconds["burn_indices_stack"] = timed(
            lambda: composite.burn_indices(obs, tables.PRE, tables.POST), runs
        )
        print(f"stack of {count} rows: {seconds['burn_indices_stack']}", file=sys.stderr)
        seconds["severity_job_stack"] = severity_job(spark, obs)
        print(f"whole job: {seconds['severity_job_stack']}", file=sys.stderr)
    seconds["comb_cells"] = comb_cells(spark, runs)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
