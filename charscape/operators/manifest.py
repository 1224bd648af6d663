"""What a product consists of: the files that were written for it, and the address under which they lie.

A manifest has one row for each job and product: ``object``, the path below the store's root, which is the
file of a product of one file and else the folder; its media type, files and bytes. It is made from
the metadata of the written files, so it names nothing that does not exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.operators.catalog import JOB

MANIFEST = (
    "fire_event_name string, job_id string, product string, object string, media_type string, "
    "files long, bytes long, ingest_seq long"
)


def written_products(
    written: DataFrame,
    jobs: DataFrame,
    root: str,
    product: str,
    media_type: str,
    ingest_seq: int,
    folder: bool,
    by: Sequence[str] = JOB,
) -> DataFrame:
    """One row per job that has data in ``written``, a table as it is read from files.

    With ``folder`` the product is the folder of all its files, and else the one file it has.
    """
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    # One row for each file and task goes into the shuffle.
    files = (
        written.select(*by, path.alias("file"), size.alias("size"))
        .join(jobs.select(*by).distinct(), list(by), "left_semi")
        .groupBy(*by, "file").agg(F.first("size").alias("size"))
    )
    place = F.min(F.regexp_replace("file", "/[^/]*$", "")) if folder else F.min("file")
    return files.groupBy(*by).agg(
        place.alias("place"), F.count("*").alias("files"), F.sum("size").alias("bytes")
    ).select(
        *by,
        F.lit(product).alias("product"),
        below_root(F.col("place"), root).alias("object"),
        F.lit(media_type).alias("media_type"),
        "files",
        "bytes",
        F.lit(ingest_seq).cast("long").alias("ingest_seq"),
    )


def below_root(path: Column, root: str) -> Column:
    """The part of a file's address behind the root, whatever scheme and slashes they start with."""
    bare = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.substring_index(path, bare, -1)


def addressed(jobs: DataFrame, manifest: DataFrame, base: str, urls: dict[str, str]) -> DataFrame:
    """Jobs with the address and media type of their products: ``urls`` names the column of each product.

    The type is given as ``<column>_type``. A product that was not written has neither.
    """
    address = F.concat(F.lit(base.rstrip("/") + "/"), F.col("object"))
    place = F.struct(address.alias("href"), F.col("media_type").alias("type"))

    def newest(product: str) -> Column:
        own = F.col("product") == product
        return F.max_by(F.when(own, place), F.when(own, F.col("ingest_seq"))).alias(f"_{product}")

    wide = manifest.groupBy(*JOB).agg(*[newest(product) for product in urls])
    found = jobs.join(wide, list(JOB), "left")
    return found.withColumns({
        name: column for p, url in urls.items()
        for name, column in ((url, F.col(f"_{p}")["href"]), (f"{url}_type", F.col(f"_{p}")["type"]))
    }).drop(*[f"_{p}" for p in urls])
