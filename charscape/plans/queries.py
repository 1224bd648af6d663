"""The operators as queries over the star-schema tables.

Every query is ``(spark, sf_dir) -> DataFrame`` and reads its tables whole. Columns are scalars
with fixed names; sums of doubles are rounded to six digits, since their order is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape import constants as C
from charscape.functions import geojson, geometry, naming, projection, spectral, timeparse
from charscape.operators import catalog, categories, composite, grids, layers, scenes, spatial, zonal
from charscape.operators.requests import check_requests, job_observations
from charscape.plans import vegetation
from charscape.sources import readers, sinks, tables
from charscape.sources.workspace import new_path
from charscape.streaming.items import append_items_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
AOI = [(-118.3, 32.2), (-115.1, 33.9), (-117.9, 36.4), (-118.3, 32.2)]
SCAN_BOX = (-116.4985, 33.7999, -116.4935, 33.8071)
SCENE_RANGE = ("2024-01-05", "2024-01-25")
EVENT = "event7"
ITEM_ID = "event7-severity-1"
BOUNDARY_ID = "event7-boundary-6"
SEARCH_BOX = (-118.95, 33.95, -117.05, 35.05)
SEARCH_INTERVAL = "1996-01-01/1999-06-30"
CREATED = "2024-06-01T00:00:00Z"
LEVELS = 3
FLAT_ITEM = (
    "id",
    "fire_event_name",
    "job_id",
    "product_type",
    "boundary_type",
    "datetime",
    "minx",
    "miny",
    "maxx",
    "maxy",
    "ingest_seq",
)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def indices(spark: SparkSession, sf: str) -> DataFrame:
    return composite.burn_indices(tables.observations(spark, sf), tables.PRE, tables.POST)


def matrix(
    spark: SparkSession, sf: str, measure: str = "area", null_type: bool = False
) -> DataFrame:
    return zonal.veg_fire_matrix(
        indices(spark, sf),
        tables.zones(spark, sf, null_type),
        tables.PIXEL_HA,
        tables.SQUARE_METRES_PER_CELL,
        measure=measure,
        cell=tables.CELL,
    )


def class_table(spark: SparkSession, sf: str, measure: str = "area") -> DataFrame:
    return zonal.zone_class_table(
        indices(spark, sf),
        tables.zones(spark, sf),
        tables.PIXEL_HA,
        tables.SQUARE_METRES_PER_CELL,
        measure=measure,
        cell=tables.CELL,
    )


def pixel_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel of the grid: one per part."""
    return tables.table(spark, sf, "part").select(
        F.expr("p_partkey div 50").alias("row"), F.expr("p_partkey % 50").alias("col")
    )


def zone_pairs(spark: SparkSession, sf: str, grid: DataFrame | None = None) -> DataFrame:
    return spatial.zone_pixel_join(
        grid if grid is not None else pixel_grid(spark, sf),
        tables.zones(spark, sf),
        cell=tables.CELL,
    )


def dissolved(spark: SparkSession, sf: str) -> DataFrame:
    pairs = zone_pairs(spark, sf, indices(spark, sf).select("row", "col", "rbr"))
    return zonal.dissolve(pairs, values=["rbr"])


def clip_triangle(spark: SparkSession, sf: str) -> DataFrame:
    """A triangle over the extent of all zones."""
    box = zonal.total_bounds(tables.zones(spark, sf))
    x_mid = (F.col("minx") + F.col("maxx")) / 2
    corners = [
        (F.col("minx"), F.col("miny")),
        (F.col("maxx"), F.col("miny")),
        (x_mid, F.col("maxy")),
        (F.col("minx"), F.col("miny")),
    ]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    return box.select(F.array(ring).alias("rings"))


def flat(items: DataFrame) -> DataFrame:
    return items.select(*FLAT_ITEM)


def job_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One finished job per order, with everything the item builders need."""
    items = tables.items(spark, sf)
    event, job = F.col("fire_event_name"), F.col("job_id")
    return items.select(
        "fire_event_name",
        "job_id",
        F.coalesce("boundary_type", F.lit("coarse")).alias("boundary_type"),
        "datetime",
        "geometry",
        *catalog.BBOX,
        "ingest_seq",
        naming.product_url(tables.BASE_URL, event, job, "rbr.tif").alias("cog_url"),
        naming.product_url(tables.BASE_URL, event, job, "boundary.geojson").alias("geojson_url"),
        naming.product_url(tables.BASE_URL, event, job, "veg_fire_matrix.csv").alias("matrix_url"),
    )


def built_items(spark: SparkSession, sf: str) -> DataFrame:
    jobs = job_rows(spark, sf)
    base = tables.CATALOG_URL
    return catalog.union_items(
        catalog.severity_items(jobs, base),
        catalog.boundary_items(jobs, base),
        catalog.matrix_items(jobs, base),
    )


# --- sources and sinks --------------------------------------------------------------------


@query("scene_search")
def _(spark, sf):
    found = scenes.search_scenes(tables.scenes(spark, sf), AOI, *SCENE_RANGE)
    return found.select("scene_id", "ts", "minx", "miny", "maxx", "maxy")


@query("scene_search_jobs")
def _(spark, sf):
    """Every job's own scenes, by area and time."""
    return scenes.search_scenes_of_jobs(
        tables.scenes(spark, sf), tables.search_areas(spark, sf), columns=["scene_id", "ts"]
    ).select("job_id", "scene_id", "ts")


@query("aoi_intersects_jobs")
def _(spark, sf):
    """Catalogue items on the area of each job."""
    return scenes.meeting_pairs(
        tables.items(spark, sf), tables.search_areas(spark, sf).withColumnRenamed("job_id", "area_id"),
        ["area_id"], columns=["ingest_seq"],
    ).select("area_id", "ingest_seq")


@query("observation_scan")
def _(spark, sf):
    return composite.scan_observations(tables.observations(spark, sf), SCAN_BOX).select(
        "scene_id", "ts", "band", "row", "col", "value"
    )


@query("observation_scan_jobs")
def _(spark, sf):
    """What two distant jobs read of observations stored by band, month and area."""
    path = new_path(spark, "observations")
    seen = tables.wide_observations(spark, sf)
    sinks.write_observations(seen, path)
    jobs = check_requests(tables.distant_requests(spark, sf))
    return job_observations(readers.read_observations(spark, path), jobs).select(
        "job_id", "tile_id", "row", "col", "band", "ts", "value")


@query("buffered_bounds")
def _(spark, sf):
    named = tables.items(spark, sf).select(
        F.lit("item").alias("source"), F.col("ingest_seq").alias("key"), *catalog.BBOX
    )
    zones = tables.zones(spark, sf).select(
        F.lit("zone").alias("source"), F.col("zone_id").alias("key"), *catalog.BBOX
    )
    both = named.unionByName(zones)
    grown = geometry.buffered_bounds({c: F.col(c) for c in catalog.BBOX})
    return both.select("source", "key", *[r6(column).alias(n) for n, column in grown.items()])


@query("severity_grid_scan")
def _(spark, sf):
    path = new_path(spark, "grid")
    indices(spark, sf).select("row", "col", "rbr").write.parquet(path)
    metres = grids.GridGeometry(0.0, 0.0, 20.0, -20.0)
    return grids.load_grid(readers.read_grid(spark, path), metres).select(
        "row", "col", "rbr", "pixel_area_ha"
    )


@query("zone_scan")
def _(spark, sf):
    path = new_path(spark, "zones")
    properties = F.struct("zone_id", F.col("veg_type").alias("MapUnit_ID"))
    tables.lonlat_zones(spark, sf).select(
        geojson.feature_text(F.col("rings"), properties).alias("value")
    ).write.text(path)
    zones = readers.read_geojson_zones(spark, path)
    return zones.select(
        "zone_id",
        "veg_type",
        *[r6(c).alias(c) for c in catalog.BBOX],
        F.size(F.get("rings", F.lit(0))).cast("bigint").alias("points"),
    )


@query("items_scan")
def _(spark, sf):
    path = new_path(spark, "items")
    sinks.append_items(tables.items(spark, sf), path)
    return flat(readers.read_items(spark, path))


@query("collection_listing")
def _(spark, sf):
    return catalog.collections(tables.items(spark, sf))


@query("items_publish")
def _(spark, sf):
    source, target = new_path(spark, "items"), new_path(spark, "published")
    sinks.append_items(tables.items(spark, sf), source)
    sinks.publish_items(spark, source, target)
    return flat(readers.read_published_items(spark, target))


@query("index_grid_sink")
def _(spark, sf):
    path = new_path(spark, "grid")
    products = indices(spark, sf).withColumns(
        {"fire_event_name": F.lit("event-1"), "job_id": F.lit("job-1")}
    )
    sinks.write_index_grid(products, path, composite.INDICES, fill_nodata=True)
    stored = spark.read.parquet(path)
    return stored.select(
        "fire_event_name", "job_id", "row", "col", *[F.col(n).cast("double").alias(n) for n in composite.INDICES]
    )


@query("overview_pyramid")
def _(spark, sf):
    return rounded(grids.overview_pyramid(indices(spark, sf), LEVELS), "rbr")


@query("matrix_csv_sink")
def _(spark, sf):
    path = new_path(spark, "matrix")
    sinks.write_matrix_csv(zonal.present(matrix(spark, sf)), path)
    types = ["string"] * 2 + ["double"] * 5
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(C.MATRIX_COLUMNS, types))
    return spark.read.schema(schema).option("header", True).csv(path)


@query("items_append")
def _(spark, sf):
    path = new_path(spark, "items")
    jobs, base = job_rows(spark, sf), tables.CATALOG_URL
    for build in (catalog.severity_items, catalog.boundary_items, catalog.matrix_items):
        sinks.append_items(build(jobs, base), path)
    return flat(readers.read_items(spark, path))


@query("geojson_sink")
def _(spark, sf):
    path = new_path(spark, "geojson")
    docs = tables.geojson_docs(spark, sf)
    accepted = geojson.parse_polygons(docs).where("reason IS NULL").select(
        F.concat(F.lit("event"), (F.col("zone_id") % 20).cast("string")).alias("fire_event_name"),
        F.col("zone_id").cast("string").alias("job_id"),
        F.lit("uploaded").alias("name"),
        "rings",
    )
    sinks.write_geojson(
        accepted.withColumn(
            "document",
            geojson.collection_text(F.col("rings"), geojson.created_properties(F.lit(CREATED))),
        ),
        path,
    )
    return spark.read.option("inferSchema", False).text(path).select(
        "fire_event_name", F.col("job_id").cast("bigint").alias("job_id"), "name",
        F.col("value").alias("document"),
    )


@query("publish_urls")
def _(spark, sf):
    event, job = F.col("fire_event_name"), F.col("job_id")
    return tables.items(spark, sf).select(
        "ingest_seq",
        *[
            naming.product_url(tables.BASE_URL, event, job, f"{n}.tif").alias(f"{n}_url")
            for n in composite.INDICES
        ],
    )


# --- projections and filters --------------------------------------------------------------


@query("date_window_filter")
def _(spark, sf):
    return composite.filter_window(tables.observations(spark, sf), tables.PRE).select(
        "scene_id", "ts", "band", "row", "col", "value"
    )


@query("band_select")
def _(spark, sf):
    return composite.select_band(tables.observations(spark, sf), C.NIR_BAND).select(
        "scene_id", "row", "col", "value"
    )


@query("full_date_range")
def _(spark, sf):
    whole = timeparse.hull(tables.PRE, tables.POST)
    return composite.filter_window(tables.observations(spark, sf), whole).select("scene_id", "ts")


@query("severity_classify")
def _(spark, sf):
    return composite.classify(indices(spark, sf)).select("row", "col", "rbr", "severity_class")


@query("severity_masks")
def _(spark, sf):
    return composite.severity_masks(indices(spark, sf)).select("row", "col", *C.SEVERITY_CLASSES)


@query("nodata_normalise")
def _(spark, sf):
    clean = composite.normalise_nodata(tables.dirty_observations(spark, sf))
    stored = spectral.stored_value(F.col("value"), fill_nodata=True)
    return clean.select("scene_id", "value", stored.cast("double").alias("stored"))


@query("clip_grid")
def _(spark, sf):
    grid = indices(spark, sf).select("row", "col", "rbr")
    return spatial.clip_grid(grid, clip_triangle(spark, sf), cell=tables.CELL)


@query("project_points")
def _(spark, sf):
    lon, lat = tables.LONLAT.centre(F.col("row"), F.col("col"))
    points = pixel_grid(spark, sf).withColumns({"lon": lon, "lat": lat})
    return grids.project_points(points).select(
        "row", "col", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y")
    )


@query("regrid_nearest")
def _(spark, sf):
    return grids.regrid_nearest(
        indices(spark, sf).select("row", "col", "rbr"), tables.LONLAT, tables.UTM
    )


@query("aoi_intersects")
def _(spark, sf):
    return scenes.intersecting(tables.items(spark, sf), AOI).select("ingest_seq", "id")


@query("items_by_event")
def _(spark, sf):
    return flat(catalog.items_by_event(tables.items(spark, sf), EVENT))


@query("item_by_id")
def _(spark, sf):
    return flat(catalog.item_by_id(tables.items(spark, sf), ITEM_ID))


@query("item_by_id_and_boundary")
def _(spark, sf):
    return flat(catalog.item_by_id(tables.items(spark, sf), BOUNDARY_ID, "refined"))


@query("items_search")
def _(spark, sf):
    return flat(
        catalog.search_by_text(
            tables.items(spark, sf), EVENT, C.PRODUCT_SEVERITY, SEARCH_BOX, SEARCH_INTERVAL
        )
    )


@query("matrix_presentation")
def _(spark, sf):
    return zonal.present(matrix(spark, sf))


# --- joins --------------------------------------------------------------------------------


@query("align_pre_post")
def _(spark, sf):
    obs = tables.observations(spark, sf)
    pre = composite.window_nbr(obs, tables.PRE, "prefire_nbr")
    post = composite.window_nbr(obs, tables.POST, "postfire_nbr")
    return composite.align(pre, post).select("row", "col", "prefire_nbr", "postfire_nbr")


@query("zone_pixel_join")
def _(spark, sf):
    return zone_pairs(spark, sf).select("zone_id", "veg_type", "row", "col")


@query("zone_pixel_join_center")
def _(spark, sf):
    encoded = categories.encode(tables.zones(spark, sf), "veg_type")
    return spatial.rasterize_zones(
        pixel_grid(spark, sf), encoded, "category_id", cell=tables.CELL
    ).select("row", "col", "category_id")


@query("related_items")
def _(spark, sf):
    return catalog.related_items(tables.items(spark, sf)).select(
        "ingest_seq", "id", "product_type", "related_id", "related_href"
    )


@query("job_status")
def _(spark, sf):
    requests, items = tables.requests(spark, sf), tables.items(spark, sf)
    return catalog.union_items(
        *[
            catalog.job_status(requests, items, kind)
            for kind in (catalog.SEVERITY_JOB, catalog.REFINE_JOB, catalog.MATRIX_JOB)
        ]
    )


@query("pending_jobs")
def _(spark, sf):
    requests, items = tables.requests(spark, sf), tables.items(spark, sf)
    return catalog.pending_jobs(requests, items, catalog.MATRIX_JOB).select(*catalog.JOB)


@query("finished_jobs")
def _(spark, sf):
    requests, items = tables.requests(spark, sf), tables.items(spark, sf)
    return catalog.finished_jobs(requests, items, catalog.REFINE_JOB).select(*catalog.JOB)


@query("matrix_item_lineage")
def _(spark, sf):
    requests = tables.requests(spark, sf)
    event, job = F.col("fire_event_name"), F.col("job_id")
    url = naming.product_url(tables.BASE_URL, event, job, "veg_fire_matrix.csv")
    jobs = catalog.matrix_lineage(requests.withColumn("matrix_url", url), tables.items(spark, sf))
    return catalog.matrix_items(jobs, tables.CATALOG_URL).select(
        "id", "datetime", "geometry", *catalog.BBOX,
        catalog.asset_href("veg_fire_matrix").alias("matrix_url"),
    )


@query("refine_lineage")
def _(spark, sf):
    return catalog.refine_lineage(tables.requests(spark, sf), tables.items(spark, sf)).select(
        *catalog.JOB, "source_url", "datetime", "status"
    )


# --- aggregations -------------------------------------------------------------------------


@query("median_composite")
def _(spark, sf):
    return composite.median_composite(
        tables.dirty_observations(spark, sf), tables.PRE, tables.POST
    )


@query("median_composite_ranked")
def _(spark, sf):
    return composite.ranked_composite(
        tables.dirty_observations(spark, sf), tables.PRE, tables.POST
    )


@query("nbr")
def _(spark, sf):
    composed = composite.median_composite(
        tables.observations(spark, sf), tables.PRE, tables.POST
    )
    return composite.composite_nbr(composed)


@query("burn_indices")
def _(spark, sf):
    return indices(spark, sf)


@query("dissolve_zones")
def _(spark, sf):
    return zonal.dissolve(zone_pairs(spark, sf)).select("veg_type", "row", "col")


@query("zonal_class_area")
def _(spark, sf):
    table = zonal.zonal_classes(dissolved(spark, sf), tables.PIXEL_HA)
    return rounded(table, *zonal.CLASS_HA)


@query("zonal_class_value_sum")
def _(spark, sf):
    table = zonal.zonal_classes(dissolved(spark, sf), tables.PIXEL_HA, "value_sum")
    return rounded(table, *zonal.CLASS_HA)


@query("zone_area")
def _(spark, sf):
    area = zonal.zone_area(tables.zones(spark, sf, null_type=True), tables.SQUARE_METRES_PER_CELL)
    return rounded(area, "total_ha")


@query("park_total")
def _(spark, sf):
    totals = zonal.park_totals(class_table(spark, sf))
    return rounded(totals, "park_ha", "burnt_ha", "unburnt_ha")


@query("class_percentages")
def _(spark, sf):
    names = [f"{c}_percent" for c in C.SEVERITY_CLASSES]
    return rounded(zonal.with_percentages(class_table(spark, sf)), *names).select(
        "veg_type", *names
    )


@query("pct_of_park")
def _(spark, sf):
    return matrix(spark, sf).select("veg_type", r6("pct_of_park").alias("pct_of_park"))


@query("pct_of_burn")
def _(spark, sf):
    return matrix(spark, sf).select("veg_type", r6("pct_of_burn").alias("pct_of_burn"))


@query("mean_severity")
def _(spark, sf):
    return zonal.with_severity(class_table(spark, sf)).select(
        "veg_type", r6("mean_severity").alias("mean_severity")
    )


@query("std_severity")
def _(spark, sf):
    return zonal.with_severity(class_table(spark, sf)).select(
        "veg_type", r6("std_severity").alias("std_severity")
    )


_MATRIX = (
    *zonal.CLASS_HA,
    "total_ha",
    "pct_of_park",
    "pct_of_burn",
    "mean_severity",
    "std_severity",
)


@query("veg_fire_matrix")
def _(spark, sf):
    table = matrix(spark, sf, null_type=True)
    return rounded(table, *_MATRIX).select("color", "veg_type", *_MATRIX)


@query("veg_fire_matrix_value_sum")
def _(spark, sf):
    table = matrix(spark, sf, "value_sum", null_type=True)
    return rounded(table, *_MATRIX).select("color", "veg_type", *_MATRIX)


@query("veg_fire_matrix_jobs")
def _(spark, sf):
    """Three jobs in longitude and latitude over one layer, stored once for the projected grid."""
    path = new_path(spark, "layer")
    layer = layers.cut_layer(
        tables.lonlat_zones(spark, sf), tables.UTM, projection.DEFAULT_ZONE, tables.CELL)
    sinks.write_zone_layer(layer, path)
    grid = tables.job_grids(indices(spark, sf).select("row", "col", "rbr"))
    jobs = spark.range(4).select(
        F.lit("event1").alias("fire_event_name"), F.col("id").cast("string").alias("job_id"))
    table = vegetation.projected_matrices(
        readers.read_zone_layer(spark, path), grid, jobs, tables.LONLAT, tables.UTM)
    # The projection's last digits differ between engines.
    return table.select("job_id", "veg_type", *[F.round(c, 4).alias(c) for c in _MATRIX])


@query("veg_types")
def _(spark, sf):
    return zonal.veg_types(tables.zones(spark, sf, null_type=True))


@query("zone_total_bounds")
def _(spark, sf):
    return zonal.total_bounds(tables.zones(spark, sf))


@query("collection_extent")
def _(spark, sf):
    return catalog.collection_extents(tables.items(spark, sf))


@query("product_validity")
def _(spark, sf):
    """Each tile stands for a job."""
    jobs = indices(spark, sf).withColumn("job_id", F.col("tile_id"))
    return grids.product_validity(jobs, by=["job_id"], names=composite.INDICES, min_share=0.95)


@query("stack_shape")
def _(spark, sf):
    return composite.stack_shape(
        tables.observations(spark, sf), {"pre": tables.PRE, "post": tables.POST}
    )


@query("zonal_mean_raw")
def _(spark, sf):
    raw = zonal.zonal_raw(dissolved(spark, sf), tables.PIXEL_HA)
    return rounded(raw, "severity_sum", "severity_mean", "original_ha")


# --- windows and set operations -----------------------------------------------------------


@query("latest_item")
def _(spark, sf):
    return flat(catalog.latest_items(tables.items(spark, sf)))


@query("latest_severity_per_event")
def _(spark, sf):
    return catalog.latest_severity_per_event(tables.items(spark, sf))


@query("category_encode")
def _(spark, sf):
    return categories.encode(tables.zones(spark, sf, null_type=True), "veg_type").select(
        "zone_id", "veg_type", "category_id"
    )


@query("append_union")
def _(spark, sf):
    items = tables.items(spark, sf)
    matrix_rows = items.where(F.col("product_type") == C.PRODUCT_MATRIX).drop("boundary_type")
    others = items.where(F.col("product_type") != C.PRODUCT_MATRIX)
    return flat(catalog.union_items(matrix_rows, others))


# --- scalar functions ---------------------------------------------------------------------


def _from_nbrs(spark: SparkSession, sf: str, name: str, formula) -> DataFrame:
    grid = indices(spark, sf)
    value = formula(F.col("prefire_nbr"), F.col("postfire_nbr"))
    return grid.select("row", "col", value.alias(name))


@query("dnbr")
def _(spark, sf):
    return _from_nbrs(spark, sf, "dnbr", spectral.dnbr)


@query("rdnbr")
def _(spark, sf):
    return _from_nbrs(spark, sf, "rdnbr", spectral.rdnbr)


@query("rbr")
def _(spark, sf):
    return _from_nbrs(spark, sf, "rbr", spectral.rbr)


@query("pixel_area")
def _(spark, sf):
    """Every zone's bounding box as if it were one pixel, rows running southwards."""
    width = (F.col("maxx") - F.col("minx")) * 20
    height = (F.col("miny") - F.col("maxy")) * 20
    return tables.zones(spark, sf).select(
        "zone_id",
        zonal.pixel_area_ha(width, height).alias("pixel_area_ha"),
        r6(zonal.zone_area_ha(F.col("rings"), 400.0)).alias("zone_ha"),
    )


@query("rounding")
def _(spark, sf):
    """Half-even rounding of exact decimals, where ties do occur."""
    price = F.col("l_extendedprice").cast("decimal(20,2)")
    return tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.bround(price, 1).cast("double").alias("to_tenths"),
        F.bround(price, 0).cast("double").alias("to_units"),
    )


@query("veg_color")
def _(spark, sf):
    return zonal.veg_types(tables.zones(spark, sf, null_type=True)).select(
        "veg_type", naming.colour(F.col("veg_type")).alias("color")
    )


@query("random_palette")
def _(spark, sf):
    channels = naming.palette(F.col("veg_type"))
    return zonal.veg_types(tables.zones(spark, sf)).select(
        "veg_type", *[c.alias(n) for n, c in channels.items()]
    )


@query("item_ids")
def _(spark, sf):
    event, job = F.col("fire_event_name"), F.col("job_id")
    return tables.items(spark, sf).select(
        "ingest_seq",
        *[
            naming.item_id(event, product, job).alias(f"{infix.replace('-', '_')}_id")
            for product, infix in C.ITEM_ID_INFIX.items()
        ],
    )


@query("asset_paths")
def _(spark, sf):
    event, job, base = F.col("fire_event_name"), F.col("job_id"), tables.CATALOG_URL
    return tables.items(spark, sf).select(
        "ingest_seq",
        naming.product_path(event, job, "rbr.tif").alias("cog_path"),
        naming.product_path(event, job, "coarse_boundary.geojson").alias("boundary_path"),
        naming.product_path(event, job, "veg_fire_matrix.csv").alias("matrix_path"),
        naming.item_url(base, event, F.col("id")).alias("item_url"),
        naming.severity_item_url(base, event, job).alias("related_url"),
        naming.collection_url(base, event).alias("collection_url"),
        naming.parquet_url(base, event).alias("parquet_url"),
        naming.collection_path(event).alias("collection_path"),
    )


@query("titles")
def _(spark, sf):
    event, kind = F.col("fire_event_name"), F.col("boundary_type")
    return tables.items(spark, sf).select(
        "ingest_seq",
        naming.capitalised(kind).alias("kind_title"),
        naming.boundary_title(event, kind).alias("boundary_title"),
        naming.matrix_title(event).alias("matrix_title"),
    )


@query("name_from_path")
def _(spark, sf):
    ending = F.when(F.col("product_type") == C.PRODUCT_MATRIX, ".csv").otherwise(".parquet")
    named = tables.items(spark, sf).select(
        "ingest_seq", F.concat("fire_event_name", ending).alias("file_name")
    )
    return named.withColumn("event", naming.event_of_file(F.col("file_name")))


def interval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Interval texts of seven kinds from the orders' dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = timeparse.utc_text(F.col("o_orderdate"))
    later = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd")
    kinds = [
        F.concat(day, F.lit("/"), later),
        F.concat(day, F.lit("/..")),
        F.concat(F.lit("../"), later),
        day,
        F.concat(stamp, F.lit("/"), later),
        F.concat(day, F.lit("/"), later, F.lit("/x")),
        F.concat(F.lit("/"), F.lit("nonsense")),
    ]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 7 == i, k) for i, k in enumerate(kinds)])
    return tables.table(spark, sf, "orders").select("o_orderkey", text.alias("interval"))


@query("interval_parse")
def _(spark, sf):
    start, end = timeparse.parse_interval(F.col("interval"))
    parsed = interval_rows(spark, sf).withColumns({"start_ts": start, "end_ts": end})
    day = "yyyy-MM-dd"
    return parsed.withColumn(
        "search_text",
        timeparse.interval_text(F.date_format("start_ts", day), F.date_format("end_ts", day)),
    )


@query("utc_format")
def _(spark, sf):
    return tables.scenes(spark, sf).select(
        "scene_id", timeparse.utc_text(F.col("ts")).alias("utc_text")
    )


@query("geojson_validate")
def _(spark, sf):
    return geojson.parse_polygons(tables.geojson_docs(spark, sf)).select(
        "zone_id",
        F.col("reason").isNull().alias("is_valid"),
        "reason",
        F.size(F.get("rings", F.lit(0))).cast("bigint").alias("points"),
    )


def accepted_rings(spark: SparkSession, sf: str) -> DataFrame:
    parsed = geojson.parse_polygons(tables.geojson_docs(spark, sf))
    return parsed.where("reason IS NULL").select("zone_id", "rings")


@query("geojson_feature")
def _(spark, sf):
    created = geojson.created_properties(F.lit(CREATED))
    return accepted_rings(spark, sf).select(
        "zone_id", geojson.feature_text(F.col("rings"), created).alias("feature")
    )


@query("geojson_collection")
def _(spark, sf):
    created = geojson.created_properties(F.lit(CREATED))
    extra = {"zone": F.col("zone_id")}
    return accepted_rings(spark, sf).select(
        "zone_id", geojson.collection_text(F.col("rings"), created, extra).alias("collection")
    )


@query("polygon_bounds")
def _(spark, sf):
    box = geometry.ring_bounds(F.get("rings", F.lit(0)))
    return accepted_rings(spark, sf).select(
        "zone_id", *[c.alias(n) for n, c in box.items()]
    )


@query("bbox_polygon")
def _(spark, sf):
    return tables.zones(spark, sf).select(
        "zone_id", geojson.box_text({c: F.col(c) for c in catalog.BBOX}).alias("polygon")
    )


@query("asset_href")
def _(spark, sf):
    names = ("rbr", "refined_boundary", "refined_severity", "veg_fire_matrix")
    return tables.items(spark, sf).select(
        "ingest_seq", *[catalog.asset_href(n).alias(f"{n}_href") for n in names]
    )


@query("links_append")
def _(spark, sf):
    event, job = F.col("fire_event_name"), F.col("job_id")
    related = naming.severity_item_url(tables.CATALOG_URL, event, job)
    links = catalog.add_link(F.col("links"), "related", related, C.RELATED_TITLE)
    return tables.items(spark, sf).select(
        "ingest_seq",
        F.size(links).cast("bigint").alias("links"),
        F.element_at(links, -1)["rel"].alias("last_rel"),
        F.element_at(links, -1)["href"].alias("last_href"),
        F.element_at(links, -1)["title"].alias("last_title"),
    )


@query("item_build")
def _(spark, sf):
    built = built_items(spark, sf)
    hrefs = [
        catalog.asset_href(n)
        for n in ("rbr", "refined_boundary", "veg_fire_matrix")
    ]
    return built.select(
        *FLAT_ITEM,
        "title",
        "description",
        "geometry",
        F.coalesce(*hrefs).alias("first_href"),
        F.size("links").cast("bigint").alias("links"),
        F.size("assets").cast("bigint").alias("assets"),
        F.coalesce(
            F.try_element_at("assets", F.lit("refined_severity"))["title"],
            F.element_at(F.map_values("assets"), 1)["title"],
        ).alias("asset_title"),
    )


@query("item_validate")
def _(spark, sf):
    """Every eighth item loses its id, geometry, bounds, asset or link."""
    case = F.col("ingest_seq") % 8
    spoiled = tables.items(spark, sf).withColumns(
        {
            "id": F.when(case != 1, F.col("id")),
            "geometry": F.when(case == 2, F.lit("{")).otherwise(F.col("geometry")),
            "maxx": F.when(case == 3, F.col("minx") - 1).otherwise(F.col("maxx")),
            "assets": F.when(case != 4, F.col("assets")),
            "links": F.when(case != 5, F.col("links")),
            "datetime": F.when(case != 6, F.col("datetime")),
        }
    )
    return catalog.validate_items(spoiled).select("ingest_seq", "is_valid", "reason")


@query("feature_collection_response")
def _(spark, sf):
    path = new_path(spark, "features")
    found = catalog.search_by_text(tables.items(spark, sf), EVENT, interval=SEARCH_INTERVAL)
    features = found.select(geojson.item_feature_text(set(found.columns)).alias("feature"))
    sinks.write_feature_lines(features, path)
    return spark.read.text(path).select(F.col("value").alias("feature"))


@query("items_append_stream")
def _(spark, sf):
    """Items arriving as files, newer ones first; then a retry of every tenth, and all of them again."""
    incoming, target, state, rejects = (
        new_path(spark, n) for n in ("incoming", "items", "stream-state", "rejects")
    )
    items = tables.items(spark, sf)
    recent = F.coalesce(F.col("datetime") >= F.lit("1995-06-01").cast("timestamp_ntz"), F.lit(True))
    retried = items.where("ingest_seq % 10 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000)
    for part in (items.where(recent), items.where(~recent), retried.unionByName(items)):
        part.write.mode("append").parquet(incoming)
        append_items_once(spark, incoming, target, state, rejects)
    return readers.read_items(spark, target).select("id", "boundary_type", "datetime", "ingest_seq")
