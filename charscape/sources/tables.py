"""Engine inputs derived from the star-schema tables, by plain projections.

Every mapping keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape import constants as C
from charscape.functions import geojson, naming
from charscape.functions.timeparse import DateWindow
from charscape.operators.grids import GridGeometry
from charscape.schemas import ITEMS

TILE = 16
CELL = 16
JOBS_PER_EVENT = 12
BASE_URL = "https://store.example/fire-products"
CATALOG_URL = "https://catalog.example/stac"
PRE = DateWindow("1995-01-01", "1997-12-31")
POST = DateWindow("1998-07-01", "2001-12-31")
# Pixels of 20 m; ring coordinates count pixels.
PIXEL_HA = 0.04
SQUARE_METRES_PER_CELL = 400.0
# The same grid in degrees, rows running northwards.
LONLAT = GridGeometry(-116.5, 33.8, 0.0002, 0.0002)
UTM = GridGeometry(546000.0, 3739000.0, 20.0, 20.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item, at the pixel of its part."""
    col, row = F.expr("l_partkey % 50"), F.expr("l_partkey div 50")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("scene_id"),
            F.col("l_shipdate").alias("ts"),
            F.when(F.col("l_linenumber") % 2 == 1, C.NIR_BAND)
            .otherwise(C.SWIR_BAND)
            .alias("band"),
            row.alias("row"),
            col.alias("col"),
            F.col("l_quantity").alias("value"),
            "l_linenumber",
        )
        .withColumns(
            {
                "tile_id": F.expr(f"(row div {TILE}) * 1000 + col div {TILE}"),
                "x": F.lit(LONLAT.origin_x) + F.col("col") * LONLAT.pixel_width,
                "y": F.lit(LONLAT.origin_y) + F.col("row") * LONLAT.pixel_height,
            }
        )
    )


def dirty_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with NULL, NaN and nodata in place of every fifth, sixth and seventh line."""
    line = F.col("l_linenumber")
    return observations(spark, sf_dir).withColumn(
        "value",
        F.when(line == 7, F.lit(None).cast("double"))
        .when(line == 6, F.lit(C.NODATA))
        .when(line == 5, F.lit(float("nan")))
        .otherwise(F.col("value")),
    )


def zones(spark: SparkSession, sf_dir: str, null_type: bool = False) -> DataFrame:
    """One five-sided polygon per supplier; its vegetation type is the supplier's region."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    named = (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, F.col("n_regionkey") == region["r_regionkey"])
        .select(
            F.col("s_suppkey").alias("zone_id"),
            F.col("r_name").alias("veg_type"),
            (F.col("s_suppkey") % 10 * 5 + 0.25).alias("c0"),
            (F.expr("s_suppkey div 10") * 4 + 0.25).alias("r0"),
        )
    )
    if null_type:
        named = named.withColumn(
            "veg_type", F.when(F.col("zone_id") % 10 != 9, F.col("veg_type"))
        )

    def point(dx: int, dy: int) -> Column:
        return F.struct((F.col("c0") + dx).alias("x"), (F.col("r0") + dy).alias("y"))

    ring = F.array(
        *[point(*p) for p in ((0, 0), (6, 0), (6, 3), (3, 5), (0, 5), (0, 0))]
    )
    return named.select(
        "zone_id",
        "veg_type",
        F.array(ring).alias("rings"),
        F.col("c0").cast("double").alias("minx"),
        F.col("r0").cast("double").alias("miny"),
        (F.col("c0") + 6).cast("double").alias("maxx"),
        (F.col("r0") + 5).cast("double").alias("maxy"),
    )


def lonlat_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with ring vertices in degrees."""

    def vertex(p: Column) -> Column:
        return F.struct(
            (F.lit(LONLAT.origin_x) + p["x"] * LONLAT.pixel_width).alias("x"),
            (F.lit(LONLAT.origin_y) + p["y"] * LONLAT.pixel_height).alias("y"),
        )

    return zones(spark, sf_dir).withColumn(
        "rings", F.transform("rings", lambda r: F.transform(r, vertex))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue item per order."""
    order = table(spark, sf_dir, "orders")
    event = F.concat(F.lit("event"), (F.col("o_orderkey") % 20).cast("string"))
    job = (F.expr("(o_orderkey div 4) % 10")).cast("string")
    status = F.col("o_orderstatus")
    product = (
        F.when(status == "F", C.PRODUCT_SEVERITY)
        .when(status == "O", C.PRODUCT_BOUNDARY)
        .otherwise(C.PRODUCT_MATRIX)
    )
    flat = order.select(
        event.alias("fire_event_name"),
        job.alias("job_id"),
        product.alias("product_type"),
        F.when(
            status != "P",
            F.when(F.col("o_orderpriority") < "3", "refined").otherwise("coarse"),
        ).alias("boundary_type"),
        F.col("o_orderdate").alias("datetime"),
        F.col("o_orderkey").alias("ingest_seq"),
        (F.lit(-120.0) + (F.col("o_custkey") % 40) * 0.1).alias("minx"),
        (F.lit(33.0) + (F.col("o_custkey") % 30) * 0.1).alias("miny"),
    ).withColumns({"maxx": F.col("minx") + 0.2, "maxy": F.col("miny") + 0.2})

    def url(name: str) -> Column:
        versioned = F.concat(F.lit(f"{name}?generation="), F.col("ingest_seq").cast("string"))
        return naming.product_url(BASE_URL, F.col("fire_event_name"), F.col("job_id"), versioned)

    def one(name: str, file_name: str, media: str) -> Column:
        return F.struct(
            F.lit(name).alias("key"),
            F.struct(
                url(file_name).alias("href"),
                F.lit(media).alias("type"),
                F.lit(None).cast("string").alias("title"),
                F.lit(None).cast("string").alias("description"),
                F.array(F.lit("data")).alias("roles"),
            ).alias("value"),
        )

    assets = F.map_from_entries(
        F.when(
            F.col("product_type") == C.PRODUCT_SEVERITY,
            F.array(one("rbr", "rbr.tif", C.MEDIA_COG)),
        )
        .when(
            F.col("product_type") == C.PRODUCT_BOUNDARY,
            F.array(
                one("refined_boundary", "refined_boundary.geojson", C.MEDIA_GEOJSON),
                one("refined_severity", "refined_rbr.tif", C.MEDIA_COG),
            ),
        )
        .otherwise(F.array(one("veg_fire_matrix", "veg_fire_matrix.csv", C.MEDIA_CSV)))
    )
    identifier = naming.item_id_by_product(
        F.col("fire_event_name"), F.col("product_type"), F.col("job_id")
    )
    self_link = F.array(
        F.struct(
            F.lit("self").alias("rel"),
            naming.item_url(CATALOG_URL, F.col("fire_event_name"), identifier).alias("href"),
            F.lit(C.MEDIA_JSON).alias("type"),
            F.lit(None).cast("string").alias("title"),
        )
    )
    full = flat.withColumns(
        {
            "id": identifier,
            "title": F.lit(None),
            "description": F.lit(None),
            "geometry": geojson.box_text({c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}),
            "assets": assets,
            "links": self_link,
        }
    )
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEMS.fields])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve jobs for every event of the orders; the last two never get an item."""
    event = F.concat(F.lit("event"), (F.col("o_orderkey") % 20).cast("string"))
    return (
        table(spark, sf_dir, "orders")
        .select(event.alias("fire_event_name"))
        .distinct()
        .select(
            "fire_event_name",
            F.explode(F.sequence(F.lit(0), F.lit(JOBS_PER_EVENT - 1))).alias("job"),
        )
        .select("fire_event_name", F.col("job").cast("string").alias("job_id"))
    )


def geojson_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per zone: three accepted forms and four that have to be rejected."""
    rings = F.col("rings")
    polygon = geojson.polygon_text(rings)
    feature = geojson.feature_text(rings, F.struct(F.col("veg_type").alias("name")))
    collection = geojson.collection_text(rings, F.struct(F.col("veg_type").alias("name")))
    coordinates = geojson.polygon_struct(rings)["coordinates"]
    multi = F.to_json(
        F.struct(
            F.lit("MultiPolygon").alias("type"), F.array(coordinates).alias("coordinates")
        )
    )
    unclosed = geojson.polygon_text(
        F.transform(rings, lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
    )
    forms = [
        polygon,
        feature,
        collection,
        multi,
        unclosed,
        F.substring(polygon, 1, 30),
        F.lit('{"type":"Polygon"}'),
    ]
    chosen = F.coalesce(*[F.when(F.col("zone_id") % 7 == i, f) for i, f in enumerate(forms)])
    return zones(spark, sf_dir).select("zone_id", "veg_type", chosen.alias("text"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scene per event, one degree a side."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("scene_id"),
            "ts",
            F.when(F.col("event_type").isin("view", "click"), C.SCENE_COLLECTION)
            .otherwise("other")
            .alias("collection"),
            (F.lit(-120.0) + (F.col("user_id") % 15) * 0.5).alias("minx"),
            (F.lit(32.0) + F.expr("user_id div 15") * 0.5).alias("miny"),
        )
        .withColumns({"maxx": F.col("minx") + 1.0, "maxy": F.col("miny") + 1.0})
    )


def search_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangular area and time range for every supplier."""
    key = F.col("s_suppkey")
    x, y = F.lit(-120.0) + key % 37 * 0.21, F.lit(32.0) + key * 7 % 41 * 0.17

    def point(dx: float, dy: float) -> Column:
        return F.struct((x + dx).alias("x"), (y + dy).alias("y"))

    first = F.make_timestamp_ntz(
        F.lit(2024), F.lit(1), (key % 20 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    ring = F.array(*[point(*p) for p in ((0, 0), (0.8, 0.3), (0.2, 0.9), (0, 0))])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("event"), (key % 20).cast("string")).alias("fire_event_name"),
        key.cast("string").alias("job_id"),
        F.array(ring).alias("rings"),
        x.alias("minx"), y.alias("miny"), (x + 0.8).alias("maxx"), (y + 0.9).alias("maxy"),
        first.alias("first"),
        (first + F.expr("INTERVAL 9 DAY")).alias("last"),
    )


def wide_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations on pixels of two hundredths of a degree, so that they cover several storage areas."""
    return observations(spark, sf_dir).withColumns({
        "x": F.lit(LONLAT.origin_x) + F.col("col") * 0.02,
        "y": F.lit(LONLAT.origin_y) + F.col("row") * 0.02,
    }).select("scene_id", "ts", "band", "tile_id", "row", "col", "x", "y", "value")


def distant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs at opposite corners of the wide observations, and one outside of them."""
    rows = table(spark, sf_dir, "part").agg(F.max(F.expr("p_partkey div 50")).alias("top"))
    corner = F.col("top") * 0.02

    def box(job: str, x: Column, y: Column) -> Column:
        ring = F.array(*[
            F.struct((x + dx).alias("x"), (y + dy).alias("y"))
            for dx, dy in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.08), (0.0, 0.08), (0.0, 0.0))])
        return F.struct(F.lit(job).alias("job_id"), geojson.polygon_text(F.array(ring)).alias("geometry"))

    west, south = F.lit(LONLAT.origin_x), F.lit(LONLAT.origin_y)
    return rows.select(F.inline(F.array(
        box("south-west", west + 0.013, south + 0.013),
        box("north-east", west + 0.853, south + corner - 0.067),
        box("elsewhere", west + 40, south)))).select(
        "job_id", F.lit("event1").alias("fire_event_name"), "geometry",
        F.lit(PRE.start).alias("prefire_start"), F.lit(PRE.end).alias("prefire_end"),
        F.lit(POST.start).alias("postfire_start"), F.lit(POST.end).alias("postfire_end"))


def job_grids(grid: DataFrame) -> DataFrame:
    """Three jobs, each with three quarters of a grid's pixels; a fourth asks and has none."""
    return grid.withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(
        (F.col("row") * 7 + F.col("col")) % 4 != F.col("job")
    ).withColumns({"fire_event_name": F.lit("event1"), "job_id": F.col("job").cast("string")}).drop("job")
