"""Vegetation impact matrices of refined severity grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.constants import DEFAULT_BREAKS, MEDIA_CSV, SQUARE_METRES_PER_HECTARE
from charscape.functions.projection import DEFAULT_ZONE
from charscape.operators import catalog, manifest, zonal
from charscape.operators.grids import GridGeometry, regrid_nearest
from charscape.operators.layers import ZoneLayer, layer_matrix
from charscape.plans.store import Store
from charscape.sources import readers, sinks

JOB = catalog.JOB


def job_matrices(
    grids: DataFrame,
    zones: DataFrame,
    pixel_ha: float,
    square_metres_per_unit: float,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
) -> DataFrame:
    """The matrix of every job; both tables carry event and job, zones are in grid space."""
    return zonal.veg_fire_matrix(
        grids,
        zones,
        pixel_ha,
        square_metres_per_unit,
        measure=measure,
        breaks=breaks,
        by=list(JOB),
    )


def resolve(
    spark: SparkSession,
    requests: DataFrame,
    zones: DataFrame,
    store: Store,
    pixel_ha: float,
    square_metres_per_unit: float,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    *,
    ingest_seq: int,
) -> DataFrame:
    """Write each job's matrix as CSV and register it; geometry and time are the refined grid's."""
    lineage = catalog.matrix_lineage(requests, readers.read_items(spark, store.items))
    grids = readers.read_job_grids(spark, store.refined_grids)
    matrices = job_matrices(
        grids.join(lineage.select(*JOB), list(JOB), "left_semi"),
        zones.join(lineage.select(*JOB), list(JOB), "left_semi"),
        pixel_ha,
        square_metres_per_unit,
        measure,
        breaks,
    )
    return _publish(spark, requests, lineage, matrices, store, ingest_seq)


def resolve_over_layer(
    spark: SparkSession,
    requests: DataFrame,
    layer_path: str,
    store: Store,
    source: GridGeometry,
    target: GridGeometry,
    utm_zone: int = DEFAULT_ZONE,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
    *,
    ingest_seq: int,
) -> DataFrame:
    """The same for grids in longitude and latitude over one stored layer, which was cut for ``target``.

    Every job's refined grid is projected onto the target grid, whose pixels give the areas. The layer is
    projected and cut when it is stored, not for each job.
    """
    lineage = catalog.matrix_lineage(requests, readers.read_items(spark, store.items))
    refined = readers.read_job_grids(spark, store.refined_grids).join(
        lineage.select(*JOB), list(JOB), "left_semi"
    )
    matrices = projected_matrices(
        readers.read_zone_layer(spark, layer_path), refined, lineage, source, target, utm_zone,
        measure, breaks,
    )
    return _publish(spark, requests, lineage, matrices, store, ingest_seq)


def projected_matrices(
    layer: ZoneLayer,
    grids: DataFrame,
    jobs: DataFrame,
    source: GridGeometry,
    target: GridGeometry,
    utm_zone: int = DEFAULT_ZONE,
    measure: str = "area",
    breaks: tuple[float, float] = DEFAULT_BREAKS,
) -> DataFrame:
    """The matrix of every job from its grid in longitude and latitude."""
    projected = regrid_nearest(grids, source, target, ["rbr"], by=JOB, zone=utm_zone)
    pixel_ha = abs(target.pixel_width * target.pixel_height) / SQUARE_METRES_PER_HECTARE
    return layer_matrix(layer, projected, jobs, pixel_ha, list(JOB), measure, breaks)


def _publish(
    spark: SparkSession,
    requests: DataFrame,
    lineage: DataFrame,
    matrices: DataFrame,
    store: Store,
    ingest_seq: int,
) -> DataFrame:
    """Write the matrices, register them, and answer the requests."""
    sinks.write_matrix_csv(zonal.present(matrices, list(JOB)), store.matrices, by=JOB)
    written = manifest.written_products(
        readers.read_matrices(spark, store.matrices), lineage, store.root, "veg_fire_matrix", MEDIA_CSV, ingest_seq, folder=False)
    written.write.mode("append").parquet(store.manifest)
    done = manifest.addressed(
        lineage.withColumn("ingest_seq", F.lit(ingest_seq).cast("long")),
        readers.read_manifest(spark, store.manifest), store.product_base, {"veg_fire_matrix": "matrix_url"})
    sinks.append_items(
        catalog.matrix_items(done, store.catalog_base), store.items, store.rejected_items
    )
    return catalog.job_status(
        requests, readers.read_items(spark, store.items), catalog.MATRIX_JOB
    )
