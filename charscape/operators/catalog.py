"""The item catalogue: building, checking, searching and linking product items.

The catalogue only grows: retries append further items of the same id, and readers pick the
newest. ``datetime`` orders items, ``ingest_seq`` breaks ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape import constants as C
from charscape.functions import geojson, naming
from charscape.functions.geometry import all_of, bounds_overlap
from charscape.functions.staging import stage
from charscape.functions.timeparse import interval_text, parse_interval
from charscape.schemas import ASSET, ITEMS, LINK

BBOX = ("minx", "miny", "maxx", "maxy")
JOB = ("fire_event_name", "job_id")


# --- building -----------------------------------------------------------------------------


def asset(
    href: Column,
    media_type: str,
    title: Column | str,
    description: str | None = None,
) -> Column:
    title = F.lit(title) if isinstance(title, str) else title
    return F.struct(
        href.alias("href"),
        F.lit(media_type).alias("type"),
        title.alias("title"),
        F.lit(description).cast("string").alias("description"),
        F.array(F.lit("data")).alias("roles"),
    ).cast(ASSET)


def link(rel: str, href: Column, title: str | None = None) -> Column:
    return F.struct(
        F.lit(rel).alias("rel"),
        href.alias("href"),
        F.lit(C.MEDIA_JSON).alias("type"),
        F.lit(title).cast("string").alias("title"),
    ).cast(LINK)


def add_link(links: Column, rel: str, href: Column, title: str | None = None) -> Column:
    return F.array_append(links, link(rel, href, title))


def asset_href(name: str) -> Column:
    return F.try_element_at(F.col("assets"), F.lit(name))["href"]


def _standard_links(base: str, event: Column, identifier: Column) -> Column:
    return F.array(
        link("self", naming.item_url(base, event, identifier)),
        link("collection", naming.collection_url(base, event)),
        link("root", naming.catalog_url(base)),
    )


def _to_items(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Project to the catalogue schema; columns a product lacks are NULL."""
    own = set(rows.columns)

    def column(field) -> Column:
        if field.name in columns:
            return columns[field.name]
        return F.col(field.name) if field.name in own else F.lit(None)

    return rows.select(*[column(f).cast(f.dataType).alias(f.name) for f in ITEMS.fields])


def _media_type(jobs: DataFrame, url: str, default: str) -> Column | str:
    """The type of what lies at an address, where jobs say it."""
    name = f"{url}_type"
    return F.coalesce(F.col(name), F.lit(default)) if name in jobs.columns else default


def severity_items(jobs: DataFrame, base: str) -> DataFrame:
    """Severity items of jobs with ``cog_url``, ``geometry``, bounds and ``boundary_type``."""
    event, job = F.col("fire_event_name"), F.col("job_id")
    identifier = naming.item_id(event, C.PRODUCT_SEVERITY, job)
    return _to_items(
        jobs,
        {
            "id": identifier,
            "product_type": F.lit(C.PRODUCT_SEVERITY),
            "title": F.lit(None),
            "description": F.lit(None),
            "assets": F.create_map(
                F.lit("rbr"), asset(F.col("cog_url"), _media_type(jobs, "cog_url", C.MEDIA_COG), C.RBR_TITLE)
            ),
            "links": F.array(link("self", naming.item_url(base, event, identifier))),
        },
    )


def boundary_items(jobs: DataFrame, base: str) -> DataFrame:
    """Boundary items; their geometry is the rectangle of the bounds."""
    event, job = F.col("fire_event_name"), F.col("job_id")
    kind = naming.capitalised(F.col("boundary_type"))
    identifier = naming.item_id(event, C.PRODUCT_BOUNDARY, job)
    return _to_items(
        jobs,
        {
            "id": identifier,
            "product_type": F.lit(C.PRODUCT_BOUNDARY),
            "title": naming.boundary_title(event, F.col("boundary_type")),
            "description": F.lit(None),
            "geometry": geojson.box_text({c: F.col(c) for c in BBOX}),
            "assets": F.create_map(
                F.lit("refined_boundary"),
                asset(
                    F.col("geojson_url"), _media_type(jobs, "geojson_url", C.MEDIA_GEOJSON),
                    F.concat(kind, F.lit(" Fire Boundary")),
                ),
                F.lit("refined_severity"),
                asset(
                    F.col("cog_url"), _media_type(jobs, "cog_url", C.MEDIA_COG),
                    F.concat(kind, F.lit(" Fire Severity")),
                ),
            ),
            "links": add_link(
                _standard_links(base, event, identifier),
                "related",
                naming.severity_item_url(base, event, job),
                C.RELATED_TITLE,
            ),
        },
    )


def matrix_items(jobs: DataFrame, base: str) -> DataFrame:
    event, job = F.col("fire_event_name"), F.col("job_id")
    identifier = naming.item_id(event, C.PRODUCT_MATRIX, job)
    return _to_items(
        jobs,
        {
            "id": identifier,
            "product_type": F.lit(C.PRODUCT_MATRIX),
            "boundary_type": F.lit(None),
            "title": naming.matrix_title(event),
            "description": F.lit(C.MATRIX_DESCRIPTION),
            "assets": F.create_map(
                F.lit("veg_fire_matrix"),
                asset(
                    F.col("matrix_url"),
                    _media_type(jobs, "matrix_url", C.MEDIA_CSV),
                    C.MATRIX_ASSET_TITLE,
                    C.MATRIX_ASSET_DESCRIPTION,
                ),
            ),
            "links": add_link(
                _standard_links(base, event, identifier),
                "related",
                naming.severity_item_url(base, event, job),
                C.RELATED_TITLE,
            ),
        },
    )


def union_items(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns missing in one are NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


# --- checking -----------------------------------------------------------------------------


def validate_items(items: DataFrame) -> DataFrame:
    """Adds ``is_valid`` and the first ``reason`` an item fails for."""

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.length(F.col(name)) == 0)

    box = [F.col(c) for c in BBOX]
    missing_box = box[0].isNull() | box[1].isNull() | box[2].isNull() | box[3].isNull()
    links_bad = F.col("links").isNull() | F.exists(
        "links", lambda x: x["href"].isNull() | x["rel"].isNull()
    )
    assets_bad = F.col("assets").isNull() | F.exists(
        F.map_values("assets"), lambda a: a["href"].isNull()
    )
    reason = (
        F.when(blank("id"), "id missing")
        .when(blank("fire_event_name"), "fire_event_name missing")
        .when(blank("job_id"), "job_id missing")
        .when(
            F.col("product_type").isNull()
            | ~F.col("product_type").isin(*C.ITEM_ID_INFIX),
            "product_type unknown",
        )
        .when(F.col("datetime").isNull(), "datetime missing")
        .when(blank("geometry"), "geometry missing")
        .when(F.try_parse_json("geometry").isNull(), "geometry malformed")
        .when(missing_box, "bbox missing")
        .when((box[0] > box[2]) | (box[1] > box[3]), "bbox inverted")
        .when(assets_bad, "asset without href")
        .when(links_bad, "link without rel or href")
    )
    # Computed once: merged into the filters behind, it would build every column of an item again for each use.
    return stage(items, {"reason": reason}).withColumn("is_valid", F.col("reason").isNull())


# --- searching ----------------------------------------------------------------------------


def newest(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest item per key.

    Spark keeps one row per key and task before the shuffle, so a key with very many retries
    does not gather in one place.
    """
    window = Window.partitionBy(*keys).orderBy(F.desc("datetime"), F.desc("ingest_seq"))
    return (
        items.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_items(items: DataFrame) -> DataFrame:
    return newest(items, ["id", "boundary_type"])


def items_by_event(items: DataFrame, event: str) -> DataFrame:
    return items.where(F.col("fire_event_name") == event)


def item_by_id(items: DataFrame, identifier: str, boundary_type: str | None = None) -> DataFrame:
    """The newest item of an id, of any boundary type unless one is asked for; none if unknown."""
    conditions = [F.col("id") == identifier]
    if boundary_type is not None:
        conditions.append(F.col("boundary_type") == boundary_type)
    return newest(items.where(all_of(conditions)), ["id"])


def search_items(
    items: DataFrame,
    event: str,
    product_type: str | None = None,
    bbox: Sequence[float] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Items of an event, narrowed by product, box and a possibly open time range.

    Bounds are read like those of intervals: zones count, and no item meets a malformed bound.
    """
    conditions = [F.col("fire_event_name") == event]
    if product_type:
        conditions.append(F.col("product_type") == product_type)
    if bbox:
        wanted = dict(zip(BBOX, (F.lit(float(v)) for v in bbox)))
        conditions.append(bounds_overlap({c: F.col(c) for c in BBOX}, wanted))
    low, high = parse_interval(interval_text(F.lit(start or None), F.lit(end or None)))
    if start and start != "..":
        conditions.append(F.col("datetime") >= low)
    if end and end != "..":
        conditions.append(F.col("datetime") <= high)
    return items.where(all_of(conditions))


def search_by_text(
    items: DataFrame,
    event: str,
    product_type: str | None = None,
    bbox: Sequence[float] | None = None,
    interval: str | None = None,
) -> DataFrame:
    """Search with the interval as text; anything but two parts is no restriction."""
    parts = interval.split("/") if interval else []
    start, end = parts if len(parts) == 2 else (None, None)
    return search_items(items, event, product_type, bbox, start, end)


def collections(items: DataFrame) -> DataFrame:
    """Events that have items, with the link to each."""
    return items.select("fire_event_name").distinct().select(
        "fire_event_name",
        F.lit("child").alias("rel"),
        naming.collection_path(F.col("fire_event_name")).alias("href"),
        F.lit(C.MEDIA_JSON).alias("type"),
        F.col("fire_event_name").alias("title"),
    )


def collection_extents(items: DataFrame) -> DataFrame:
    return items.groupBy("fire_event_name").agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
        F.min("datetime").alias("first_datetime"),
        F.max("datetime").alias("last_datetime"),
        F.count("*").alias("items"),
    )


def latest_severity_per_event(items: DataFrame) -> DataFrame:
    """URL of the newest severity product of each event; events without one are absent."""
    order = F.struct("datetime", "ingest_seq")
    return (
        items.where(F.col("product_type") == C.PRODUCT_SEVERITY)
        .select("fire_event_name", "datetime", "ingest_seq", asset_href("rbr").alias("href"))
        .groupBy("fire_event_name")
        .agg(F.max_by("href", order).alias("cog_url"), F.max("datetime").alias("datetime"))
    )


# --- linking ------------------------------------------------------------------------------


def severity_of_job(items: DataFrame, boundary_type: str | None = None) -> DataFrame:
    """The newest severity item of each job, optionally of one boundary type."""
    chosen = items.where(F.col("product_type") == C.PRODUCT_SEVERITY)
    if boundary_type is not None:
        chosen = chosen.where(F.col("boundary_type") == boundary_type)
    return newest(chosen, JOB)


def related_items(items: DataFrame) -> DataFrame:
    """Boundary and matrix items beside the severity item of their job.

    The severity side has one row per job; a job in which items crowd is split at run time.
    """
    severity = severity_of_job(items).select(
        *JOB, F.col("id").alias("related_id"), asset_href("rbr").alias("related_href")
    )
    others = items.where(F.col("product_type") != C.PRODUCT_SEVERITY).select(
        "id", *JOB, "product_type", "boundary_type", "datetime", "ingest_seq"
    )
    return others.join(severity, list(JOB), "left")


@dataclass(frozen=True)
class JobKind:
    """What a result lookup reads: product, boundary type, and asset per answer column."""

    name: str
    product_type: str
    boundary_type: str | None
    urls: dict[str, str]


# The three result lookups.
SEVERITY_JOB = JobKind(
    "analyze_fire_severity", C.PRODUCT_SEVERITY, "coarse", {"cog_url": "rbr"}
)
REFINE_JOB = JobKind(
    "refine",
    C.PRODUCT_BOUNDARY,
    "refined",
    {"refined_geojson_url": "refined_boundary", "cog_url": "refined_severity"},
)
MATRIX_JOB = JobKind(
    "resolve_against_veg_map", C.PRODUCT_MATRIX, None, {"fire_veg_matrix": "veg_fire_matrix"}
)


def _items_of_kind(items: DataFrame, kind: JobKind) -> DataFrame:
    conditions = [F.col("product_type") == kind.product_type]
    if kind.boundary_type is not None:
        conditions.append(F.col("boundary_type") == kind.boundary_type)
    return items.where(all_of(conditions))


def job_status(requests: DataFrame, items: DataFrame, kind: JobKind) -> DataFrame:
    """``pending`` or ``complete`` per request, with the product's URLs."""
    found = newest(_items_of_kind(items, kind), JOB).select(
        *JOB,
        F.lit(True).alias("_found"),
        *[asset_href(name).alias(column) for column, name in kind.urls.items()],
    )
    return requests.join(found, list(JOB), "left").select(
        *JOB,
        F.lit(kind.name).alias("kind"),
        F.when(F.col("_found"), F.lit("complete")).otherwise(F.lit("pending")).alias("status"),
        *kind.urls,
    )


def _jobs_with_product(items: DataFrame, kind: JobKind) -> DataFrame:
    """Distinct jobs: retries are dropped before anything is shuffled to the join."""
    return _items_of_kind(items, kind).select(*JOB).distinct()


def pending_jobs(requests: DataFrame, items: DataFrame, kind: JobKind) -> DataFrame:
    return requests.join(_jobs_with_product(items, kind), list(JOB), "left_anti")


def finished_jobs(requests: DataFrame, items: DataFrame, kind: JobKind) -> DataFrame:
    return requests.join(_jobs_with_product(items, kind), list(JOB), "left_semi")


def matrix_lineage(matrix_jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Matrix jobs with geometry, bounds and time of the job's refined severity item."""
    refined = severity_of_job(items, "refined").select(*JOB, "geometry", *BBOX, "datetime")
    return matrix_jobs.join(refined, list(JOB), "inner")


def refine_lineage(refine_jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Refinement jobs with source URL and time of the coarse product; an error without one."""
    coarse = severity_of_job(items, "coarse").select(
        *JOB, asset_href("rbr").alias("source_url"), "datetime"
    )
    return refine_jobs.join(coarse, list(JOB), "left").withColumn(
        "status", F.when(F.col("source_url").isNull(), "error").otherwise("ready")
    )
