"""Burn severity of a table of requests: from observations to grids and catalogue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.constants import MEDIA_GEOJSON, MEDIA_PARQUET
from charscape.functions import geojson
from charscape.functions.timeparse import ntz
from charscape.operators import catalog, composite, grids, manifest
from charscape.operators.requests import check_requests, job_observations, post_window, pre_window
from charscape.operators.scenes import search_scenes_of_jobs
from charscape.plans.store import Store
from charscape.sources import readers, sinks
from charscape.sources.workspace import new_path

JOB = catalog.JOB
JOB_PIXEL = (*JOB, *composite.PIXEL)
COARSE_FILE = "coarse_boundary"


def job_indices(
    observations: DataFrame, checked: DataFrame, scenes: DataFrame | None = None
) -> DataFrame:
    """The five indices of every job's pixels, in one pass over the observations.

    Scenes with bounds are searched for each job: its own area, from its first to its last window.
    """
    if scenes is not None and set(catalog.BBOX) <= set(scenes.columns):
        wanted = checked.where(F.col("status") == "ready").select(
            *JOB, "rings", *catalog.BBOX,
            F.col("pre_start").alias("first"), F.col("post_end").alias("last"),
        )
        scenes = search_scenes_of_jobs(scenes, wanted).select(*JOB, "scene_id")
    return composite.burn_indices(
        job_observations(observations, checked, scenes=scenes), pre_window(), post_window(), by=JOB_PIXEL
    )


def boundary_documents(jobs: DataFrame, name: str, created: str) -> DataFrame:
    """One collection per job, for the boundary folder."""
    return jobs.select(
        "fire_event_name",
        "job_id",
        F.lit(name).alias("name"),
        geojson.collection_text(
            F.col("rings"), geojson.created_properties(F.lit(created))
        ).alias("document"),
    )


def register_products(
    jobs: DataFrame, store: Store, grids_path: str, boundary_file: str, ingest_seq: int
) -> DataFrame:
    """Enter the written grids and boundaries of finished jobs in the manifest; the jobs with their
    addresses."""
    spark = jobs.sparkSession
    grid = readers.stored_grids(spark, grids_path)
    documents = readers.read_documents(spark, store.boundaries, boundary_file)
    kind = boundary_file.split("_")[0]
    urls = {f"{kind}_severity": "cog_url", f"{kind}_boundary": "geojson_url"}
    written = manifest.written_products(
        grid, jobs, store.root, f"{kind}_severity", MEDIA_PARQUET, ingest_seq, folder=True
    ).unionByName(manifest.written_products(
        documents, jobs, store.root, f"{kind}_boundary", MEDIA_GEOJSON, ingest_seq, folder=False))
    written.write.mode("append").parquet(store.manifest)
    return manifest.addressed(
        jobs, readers.read_manifest(spark, store.manifest), store.product_base, urls)


def product_items(addressed: DataFrame, store: Store) -> DataFrame:
    """Severity and boundary items of finished jobs with addresses."""
    boundary = addressed.withColumn("datetime", F.col("boundary_datetime"))
    return catalog.union_items(
        catalog.severity_items(addressed, store.catalog_base),
        catalog.boundary_items(boundary, store.catalog_base),
    )


def analyze(
    spark: SparkSession,
    observations: DataFrame,
    requests: DataFrame,
    store: Store,
    now: str,
    ingest_seq: int,
    scenes: DataFrame | None = None,
) -> DataFrame:
    """Run all requests and publish what is valid; returns one status row per request.

    ``now`` stamps the items; ``ingest_seq`` tells attempts apart and grows from one to the next.
    ``scenes`` limits the observations: a scene table, in which every job's own are searched, or the
    result of a search. Grids are written once and everything after reads them back, so a lost
    executor costs no second pass over the observations.
    """
    checked = check_requests(requests)
    ready = checked.where(F.col("status") == "ready").select(*JOB)
    sinks.write_index_grid(
        job_indices(observations, checked, scenes), store.coarse_grids, composite.INDICES, jobs=ready
    )
    written = readers.read_job_grids(spark, store.coarse_grids).join(ready, list(JOB), "left_semi")
    validity = grids.product_validity(written, composite.INDICES).select(
        *JOB, F.col("status").alias("outcome")
    )
    judged = checked.join(validity, list(JOB), "left").withColumn(
        "status",
        F.when(F.col("status") == "error", F.concat(F.lit("error: "), F.col("reason"))).otherwise(
            F.coalesce("outcome", F.lit("failed_validation"))
        ),
    )
    # One row per job, read three times below: written so that grids are checked once.
    outcome_path = new_path(spark, "outcome")
    judged.write.parquet(outcome_path)
    outcome = spark.read.parquet(outcome_path)
    done = outcome.where(F.col("status") == "completed").withColumns(
        {
            "boundary_type": F.lit("coarse"),
            "datetime": ntz(now),
            "boundary_datetime": ntz(now),
            "ingest_seq": F.lit(ingest_seq).cast("long"),
            "geometry": geojson.polygon_text(F.col("rings")),
        }
    )
    sinks.write_geojson(boundary_documents(done, COARSE_FILE, now), store.boundaries)
    placed = register_products(done, store, store.coarse_grids, COARSE_FILE, ingest_seq)
    sinks.append_items(product_items(placed, store), store.items, store.rejected_items)
    return outcome.select("job_id", "fire_event_name", "status")
