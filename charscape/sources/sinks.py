"""Writers of products and of the catalogue."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.functions import areas
from charscape.functions.spectral import stored_value
from charscape.operators.catalog import JOB, validate_items
from charscape.operators.layers import ZoneLayer
from charscape.schemas import AREA, ITEMS, MONTH
from charscape.sources import readers

# Tiles that are written together.
TILE_BLOCK = 256
# Folders of observations that one write makes, about: areas are as large as this takes.
FOLDERS = 2048


def _area_level(keyed: DataFrame, folders: int) -> int:
    """The smallest areas with which a table has at most so many folders, by one aggregate of fixed size."""
    counts = keyed.agg(*[
        F.approx_count_distinct(F.struct("band", MONTH, areas.storage_area(F.col("_place"), level))).alias(str(level))
        for level in areas.LEVELS
    ]).first()
    return next((level for level in areas.LEVELS if counts[str(level)] <= folders), areas.LEVELS[-1])


def write_observations(observations: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Folders by band, month and area; within them clustered by tile, so that box, tile and time filters
    skip folders and files. Areas grow with the region that is written, so that the number of folders does not.
    Small folders are written together and a crowded one is split, by the sizes that the shuffle reports."""
    keyed = observations.withColumns({
        MONTH: F.date_format("ts", "yyyy-MM"),
        "_place": areas.place(F.col("x"), F.col("y")),
    })
    (
        keyed.withColumn(AREA, areas.storage_area(F.col("_place"), _area_level(keyed, folders)))
        .drop("_place")
        .hint("rebalance", "band", MONTH, AREA)
        .sortWithinPartitions("band", MONTH, AREA, "tile_id", "row", "col")
        .write.mode("append")
        .partitionBy("band", MONTH, AREA)
        .parquet(path)
    )


def write_index_grid(
    indices: DataFrame,
    path: str,
    names: Sequence[str],
    by: Sequence[str] = JOB,
    fill_nodata: bool = False,
    jobs: DataFrame | None = None,
) -> None:
    """Single-precision grid, one folder per job, sorted by tile within files.

    A job that is written again replaces its own folder only. With ``jobs``, each of them gets a row
    without a tile as well: a job without pixels then replaces what an earlier run has left.

    Rows are gathered by blocks of tiles, and partitions are merged or split by the sizes that the
    shuffle reports. Nothing is sampled, so what lies behind is evaluated once.
    """
    if jobs is not None:
        indices = indices.unionByName(jobs.select(*by).distinct(), allowMissingColumns=True)
    stored = indices.withColumns({n: stored_value(F.col(n), fill_nodata) for n in names})
    (
        stored.withColumn("_block", F.expr(f"tile_id div {TILE_BLOCK}"))
        .hint("rebalance", *by, "_block")
        .sortWithinPartitions(*by, "tile_id", "row", "col")
        .drop("_block")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_zone_layer(layer: ZoneLayer, path: str) -> None:
    """Cells sorted by place, and areas by type with the size of the cells. A layer has a path of its
    own and is not written over, so that jobs can read it at any time."""
    (
        layer.cells.hint("rebalance", "cell_r")
        .sortWithinPartitions("cell_r", "cell_c")
        .write.parquet(f"{path}/cells")
    )
    layer.areas.withColumn("cell", F.lit(layer.cell)).coalesce(1).write.parquet(f"{path}/areas")


def write_matrix_csv(
    presented: DataFrame,
    path: str,
    order: str = "Vegetation Community",
    by: Sequence[str] = (),
) -> None:
    """CSV with a header: one file, or one folder per job. A job's matrix is one row per type."""
    if by:
        placed = presented.repartition(*by).sortWithinPartitions(*by, order)
        writer = placed.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    else:
        writer = presented.coalesce(1).sortWithinPartitions(order).write
    writer.mode("overwrite").option("header", True).csv(path)


def append_items(items: DataFrame, path: str, rejects_path: str | None = None) -> None:
    """Append the valid items; invalid ones go to the reject table, or raise without one.

    Nothing that is already stored is read or rewritten. Rebalancing gives each event few files
    and splits an event that holds most of the items.
    """
    checked = validate_items(items)
    if rejects_path is None:
        failure = F.raise_error(F.concat(F.lit("invalid item: "), F.col("reason")))
        good = checked.where(F.when(F.col("is_valid"), True).otherwise(failure.cast("boolean")))
    else:
        good = checked.where("is_valid")
        checked.where(~F.col("is_valid")).write.mode("append").parquet(rejects_path)
    write_items(good, path)


def write_items(items: DataFrame, path: str, mode: str = "append") -> None:
    (
        items.select(*ITEMS.names)
        .hint("rebalance", F.col("fire_event_name"))
        .write.mode(mode)
        .partitionBy("fire_event_name")
        .parquet(path)
    )


def publish_items(spark: SparkSession, source: str, target: str) -> str:
    """Copy the catalogue to its published place, with appended small files put together.

    A version is written to a folder of its own and named in the log when it is complete; readers follow
    the log, so they see the old version until then, also if publishing fails. Returns the version. A
    missing or empty source raises.
    """
    items = spark.read.schema(ITEMS).parquet(source)
    if items.isEmpty():
        raise ValueError(f"no catalogue items in {source}")
    number, _ = readers.published_version(spark, target)
    version = f"version-{number + 1}-{uuid.uuid4().hex}"
    write_items(items, f"{target}/{version}", mode="errorifexists")
    entry = spark.createDataFrame([(number + 1, version)], readers.PUBLISHED)
    entry.coalesce(1).write.mode("append").parquet(f"{target}/{readers.PUBLISHED_LOG}")
    return version


def write_geojson(documents: DataFrame, path: str) -> None:
    """Texts in ``document`` under event, job and file name: one file per document.

    Hashing the text as well spreads the documents of one job over tasks.
    """
    columns = ("fire_event_name", "job_id", "name", "document")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        documents.select(*columns)
        .repartition(tasks, *columns)
        .write.mode("append")
        .partitionBy("fire_event_name", "job_id", "name")
        .text(path)
    )


def write_feature_lines(features: DataFrame, path: str) -> None:
    """One Feature per line in ``feature``."""
    features.select("feature").write.mode("overwrite").text(path)
