"""Identifiers, paths, titles and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from charscape.constants import (
    ITEM_ID_INFIX,
    PRODUCT_SEVERITY,
)


def item_id(event: Column, product: str, job: Column) -> Column:
    return F.concat_ws("-", event, F.lit(ITEM_ID_INFIX[product]), job)


def item_id_by_product(event: Column, product: Column, job: Column) -> Column:
    """Item id where the product type is a column."""
    return F.coalesce(
        *[F.when(product == name, item_id(event, name, job)) for name in ITEM_ID_INFIX]
    )


def product_path(event: Column, job: Column, file_name: Column | str) -> Column:
    name = F.lit(file_name) if isinstance(file_name, str) else file_name
    return F.concat_ws("/", event, job, name)


def product_url(base: str, event: Column, job: Column, file_name: Column | str) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), product_path(event, job, file_name))


def item_url(base: str, event: Column, identifier: Column) -> Column:
    return F.concat(F.lit(base + "/"), event, F.lit("/items/"), identifier, F.lit(".json"))


def severity_item_url(base: str, event: Column, job: Column) -> Column:
    return item_url(base, event, item_id(event, PRODUCT_SEVERITY, job))


def collection_url(base: str, event: Column) -> Column:
    return F.concat(F.lit(base + "/"), event, F.lit("/collection.json"))


def parquet_url(base: str, event: Column) -> Column:
    return F.concat(F.lit(base + "/"), event, F.lit(".parquet"))


def catalog_url(base: str) -> Column:
    return F.lit(f"{base}/catalog.json")


def collection_path(event: Column) -> Column:
    return F.concat(F.lit("/stac/collections/"), event)


def capitalised(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(
        F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2)))
    )


def boundary_title(event: Column, boundary_type: Column) -> Column:
    return F.concat(event, F.lit(" "), boundary_type, F.lit(" boundary"))


def matrix_title(event: Column) -> Column:
    return F.concat(F.lit("Vegetation Fire Matrix for "), event)


def event_of_file(file_name: Column) -> Column:
    """Event name of a catalogue file; NULL for other files."""
    return F.when(file_name.endswith(".parquet"), F.regexp_replace(file_name, r"\.parquet$", ""))


def _digest(name: Column) -> Column:
    return F.md5(F.coalesce(name, F.lit("None")).cast("binary"))


def colour(name: Column) -> Column:
    """Hex colour of a category, the same in every run."""
    return F.concat(F.lit("#"), F.substring(_digest(name), 1, 6))


def palette(name: Column) -> dict[str, Column]:
    """Red, green and blue of a category, 0 to 255."""
    return {
        channel: F.conv(F.substring(_digest(name), start, 2), 16, 10).cast("int")
        for channel, start in (("red", 1), ("green", 3), ("blue", 5))
    }
