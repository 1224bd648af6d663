"""Clipping of severity grids to refined boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.constants import MEDIA_GEOJSON
from charscape.functions import geojson, geometry
from charscape.functions.timeparse import ntz
from charscape.operators import catalog, composite, manifest
from charscape.operators.grids import GridGeometry, product_validity
from charscape.operators.spatial import clip_grid, zones_in_grid_space
from charscape.plans.burn_severity import JOB, boundary_documents, product_items, register_products
from charscape.plans.store import Store
from charscape.sources import readers, sinks
from charscape.sources.workspace import new_path

REFINED_FILE = "refined_boundary"
UPLOADED_FILE = "uploaded"


def check_refinements(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Adds rings, bounds, source product and status; unmatched or malformed ones are errors."""
    parsed = geojson.parse_polygons(requests, "geometry").withColumns(
        geometry.ring_bounds(F.get("rings", F.lit(0)))
    )
    found = catalog.refine_lineage(parsed, items)
    reason = F.coalesce(
        F.col("reason"), F.when(F.col("source_url").isNull(), F.lit("original grid not found"))
    )
    return found.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "ready").otherwise("error")
    )


def refine(
    spark: SparkSession,
    requests: DataFrame,
    store: Store,
    grid: GridGeometry,
    now: str,
    ingest_seq: int,
) -> DataFrame:
    """Clip each job's grid to its own polygon and publish what is valid.

    A clip without pixels, or without values, ends as ``failed_validation`` and leaves no items.
    """
    checked = check_refinements(requests, readers.read_items(spark, store.items))
    ready = checked.where(F.col("status") == "ready")
    polygons = zones_in_grid_space(
        ready.select(*JOB, "rings"),
        grid.origin_x,
        grid.origin_y,
        grid.pixel_width,
        grid.pixel_height,
    )
    coarse = readers.read_job_grids(spark, store.coarse_grids).join(
        ready.select(*JOB), list(JOB), "left_semi"
    )
    sinks.write_index_grid(
        clip_grid(coarse, polygons, by=JOB),
        store.refined_grids,
        composite.INDICES,
        jobs=ready,
    )
    written = readers.read_job_grids(spark, store.refined_grids).join(
        ready.select(*JOB), list(JOB), "left_semi"
    )
    validity = product_validity(written, composite.INDICES).select(
        *JOB, F.col("status").alias("outcome")
    )
    judged = checked.join(validity, list(JOB), "left").withColumn(
        "status",
        F.when(F.col("status") == "ready", F.coalesce("outcome", F.lit("failed_validation")))
        .otherwise(F.col("status")),
    )
    outcome_path = new_path(spark, "outcome")
    judged.write.parquet(outcome_path)
    outcome = spark.read.parquet(outcome_path)
    done = outcome.where(F.col("status") == "completed").withColumns(
        {
            "boundary_type": F.lit("refined"),
            "boundary_datetime": ntz(now),
            "ingest_seq": F.lit(ingest_seq).cast("long"),
            "geometry": geojson.polygon_text(F.col("rings")),
        }
    )
    sinks.write_geojson(boundary_documents(done, REFINED_FILE, now), store.boundaries)
    placed = register_products(done, store, store.refined_grids, REFINED_FILE, ingest_seq)
    sinks.append_items(product_items(placed, store), store.items, store.rejected_items)
    return outcome.select("job_id", "fire_event_name", "status", "reason")


def upload_boundaries(
    requests: DataFrame, store: Store, created: str, ingest_seq: int = 0
) -> DataFrame:
    """Store uploaded boundaries and answer with their address, or with the reason not to."""
    parsed = geojson.parse_polygons(requests, "geometry")
    sinks.write_geojson(
        boundary_documents(parsed.where("reason IS NULL"), UPLOADED_FILE, created), store.boundaries
    )
    accepted = parsed.where("reason IS NULL").select(*JOB)
    documents = readers.read_documents(requests.sparkSession, store.boundaries, UPLOADED_FILE)
    listed = manifest.written_products(
        documents, accepted, store.root, UPLOADED_FILE, MEDIA_GEOJSON, ingest_seq, folder=False)
    listed.write.mode("append").parquet(store.manifest)
    parsed = manifest.addressed(
        parsed, readers.read_manifest(requests.sparkSession, store.manifest), store.product_base,
        {UPLOADED_FILE: "url"})
    url = F.col("url")
    return parsed.select(
        "job_id",
        "fire_event_name",
        F.when(F.col("reason").isNull(), "complete").otherwise("error").alias("status"),
        F.when(F.col("reason").isNull(), url).alias("uploaded_geojson"),
        "reason",
    )
