"""Readers of the engine's tables. All paths are Hadoop file system URIs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from charscape.constants import MATRIX_COLUMNS
from charscape.functions import geojson, geometry
from charscape.functions.spectral import valid_value
from charscape.operators.catalog import JOB
from charscape.operators.composite import INDICES
from charscape.operators.grids import project_zones
from charscape.operators.layers import ZoneLayer
from charscape.operators.manifest import MANIFEST
from charscape.operators.spatial import CELL
from charscape.schemas import AREA, GRID, ITEMS, MONTH, OBSERVATIONS

# Published catalogues: a folder per version, and the log of the versions that are complete.
PUBLISHED_LOG = "log"
PUBLISHED = "number long, version string"

STORED = StructType(
    [*OBSERVATIONS.fields, StructField(MONTH, StringType()), StructField(AREA, LongType())]
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations stored by band, month and area; NaN and nodata become NULL."""
    return spark.read.schema(STORED).parquet(path).withColumn(
        "value", valid_value(F.col("value"))
    )


def read_grid(spark: SparkSession, path: str, severity: str = "rbr") -> DataFrame:
    return spark.read.parquet(path).withColumn(severity, valid_value(F.col(severity)))


def stored_grids(spark: SparkSession, path: str) -> DataFrame:
    """Index grids as stored, with the rows that only mark a job."""
    return spark.read.schema(GRID).parquet(path)


def read_job_grids(spark: SparkSession, path: str) -> DataFrame:
    """Index grids as written per job; the schema keeps job ids text.

    Rows without a tile only mark that a job has been written.
    """
    grids = spark.read.schema(GRID).parquet(path).where("tile_id IS NOT NULL")
    return grids.withColumns({n: valid_value(F.col(n)) for n in INDICES})


def with_ring_bounds(zones: DataFrame) -> DataFrame:
    return zones.withColumns(geometry.ring_bounds(F.flatten("rings")))


def read_zones(
    spark: SparkSession,
    path: str,
    type_column: str = "MapUnit_ID",
    utm_zone: int | None = None,
) -> DataFrame:
    """Vegetation polygons from Parquet; optionally projected from longitude and latitude."""
    zones = spark.read.parquet(path).withColumnRenamed(type_column, "veg_type")
    if utm_zone is not None:
        zones = project_zones(zones, utm_zone)
    return with_ring_bounds(zones)


def read_geojson_zones(
    spark: SparkSession,
    path: str,
    type_column: str = "MapUnit_ID",
    id_column: str = "zone_id",
    utm_zone: int | None = None,
) -> DataFrame:
    """Vegetation polygons, of one part or several, from GeoJSON lines, one Feature per line. Bad
    lines raise."""
    parsed = geojson.parse_polygons(spark.read.text(path), "value", parts=True)
    document = F.try_parse_json("value")
    failure = F.raise_error(F.concat(F.lit("GeoJSON line rejected: "), F.col("reason")))
    zones = parsed.select(
        F.try_variant_get(document, f"$.properties.{id_column}", "bigint").alias("zone_id"),
        F.try_variant_get(document, f"$.properties.{type_column}", "string").alias("veg_type"),
        F.when(F.col("reason").isNull(), F.col("rings")).otherwise(failure).alias("rings"),
    )
    if utm_zone is not None:
        zones = project_zones(zones, utm_zone)
    return with_ring_bounds(zones)


def read_zone_layer(spark: SparkSession, path: str) -> ZoneLayer:
    areas = spark.read.parquet(f"{path}/areas")
    first = areas.select("cell").first()
    cells = spark.read.parquet(f"{path}/cells")
    return ZoneLayer(cells, areas.drop("cell"), first["cell"] if first else CELL)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table; empty when nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; empty when nothing has been written yet."""
    return read_or_empty(spark, path, ITEMS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What the products of jobs consist of; empty before the first."""
    return read_or_empty(spark, path, MANIFEST)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Vegetation matrices as written per job; all columns are text."""
    columns = ", ".join(f"`{name}` string" for name in (*MATRIX_COLUMNS, *JOB))
    return spark.read.schema(columns).option("header", True).csv(path)


def read_documents(spark: SparkSession, path: str, name: str) -> DataFrame:
    """GeoJSON documents of one file name, by event and job."""
    return spark.read.schema(
        "value string, fire_event_name string, job_id string, name string"
    ).text(path).where(F.col("name") == name)


def published_version(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """Number and folder of the version that was published last; (0, None) before the first."""
    log = read_or_empty(spark, f"{target}/{PUBLISHED_LOG}", PUBLISHED)
    last = log.orderBy(F.desc("number"), F.desc("version")).first()
    return (last["number"], last["version"]) if last else (0, None)


def read_published_items(spark: SparkSession, target: str) -> DataFrame:
    """The published catalogue: the version that the log names last."""
    _, version = published_version(spark, target)
    if version is None:
        return spark.createDataFrame([], ITEMS)
    return spark.read.schema(ITEMS).parquet(f"{target}/{version}")
