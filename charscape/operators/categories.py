"""Dense integer ids of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charscape.operators.sizing import BROADCAST_ROWS, lookup_join
from charscape.sources.workspace import new_path


def category_ids(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """Categories in order with ids from ``start``; 0 stays free for "no category".

    The categories are dealt into ranges of about equal size, in order, and written. Ranks are taken
    within a range and shifted by the number of categories in earlier ones, so no task sorts all of
    them, whatever their names have in common.
    """
    path = new_path(df.sparkSession, "categories")
    (
        df.where(F.col(column).isNotNull()).select(column).distinct()
        .repartitionByRange(column)
        .withColumn("_range", F.spark_partition_id())
        .write.parquet(path)
    )
    ranged = df.sparkSession.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_rank", rank).join(F.broadcast(offsets), "_range").select(
        column, (F.col("_before") + F.col("_rank") + (start - 1)).cast("int").alias("category_id")
    )


def encode(
    df: DataFrame, column: str, start: int = 1, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Adds ``category_id``; rows of a frequent category are not gathered."""
    return lookup_join(df, category_ids(df, column, start), [column], "left", limit)
