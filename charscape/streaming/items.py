"""Job results arriving as files, appended to the catalogue by a stream.

Each micro-batch goes through the batch writer, so the catalogue keeps one layout and one set of rules:
invalid items go to the reject table, and readers and batch writers see no difference. An item is an attempt:
its id, boundary type, time and ``ingest_seq``. A retry with the same time is thus stored, and wins as the
newest. A batch that is replayed after a failure adds nothing twice: finished batches stand in a ledger, and
what an unfinished one has already written, items or rejects, is looked up among the events of the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from charscape.functions.geometry import all_of
from charscape.operators.catalog import validate_items
from charscape.schemas import ITEMS
from charscape.sources import readers, sinks

ITEM_VERSION = ("id", "boundary_type", "datetime", "ingest_seq")
LEDGER = "stream string, batch long"


def incoming_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ITEMS).parquet(path)


def _unknown(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch, once per key, whose key is not stored. Only the events of the batch are read."""
    events = batch.select(F.col("fire_event_name").alias("_event")).distinct()
    known = stored.join(
        events, F.col("fire_event_name").eqNullSafe(F.col("_event")), "left_semi"
    ).select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return batch.dropDuplicates(list(keys)).join(known, same, "left_anti")


def not_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Attempts of a batch that the catalogue does not have."""
    return _unknown(batch, stored, ITEM_VERSION)


def not_rejected(batch: DataFrame, rejects: DataFrame) -> DataFrame:
    """Invalid items of a batch that the reject table does not have; they are known by all their content."""
    content = F.sha2(F.to_json(F.struct(*ITEMS.names, "reason")), 256)
    return _unknown(
        batch.withColumn("content", content), rejects.withColumn("content", content), ["content"]
    ).drop("content")


def _stream_id(spark: SparkSession, state: str) -> str:
    """The identity that a stream keeps as long as its state folder."""
    return spark.read.json(f"{state}/metadata").first()["id"]


def append_batch(
    batch: DataFrame, batch_id: int, stream: str, target: str, rejects: str, ledger: str
) -> None:
    """Append one micro-batch, unless the ledger has it."""
    spark = batch.sparkSession
    finished = readers.read_or_empty(spark, ledger, LEDGER)
    if not finished.where((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
        return
    checked = validate_items(batch.select(*ITEMS.names))
    invalid = checked.where(~F.col("is_valid"))
    known = readers.read_or_empty(spark, rejects, checked.schema)
    not_rejected(invalid, known).write.mode("append").parquet(rejects)
    sinks.write_items(
        not_stored(checked.where("is_valid"), readers.read_items(spark, target)), target
    )
    spark.createDataFrame([(stream, batch_id)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)


def start_append(
    spark: SparkSession, source: str, target: str, state: str, rejects: str,
    ledger: str | None = None, **trigger: object,
) -> StreamingQuery:
    """Append to the catalogue until stopped, or once with ``availableNow=True``."""
    book = ledger or f"{target.rstrip('/')}-batches"

    def append(batch: DataFrame, batch_id: int) -> None:
        stream = _stream_id(batch.sparkSession, state)
        append_batch(batch, batch_id, stream, target, rejects, book)

    return (
        incoming_items(spark, source)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", state)
        .trigger(**trigger)
        .start()
    )


def append_items_once(
    spark: SparkSession, source: str, target: str, state: str, rejects: str
) -> None:
    """Append what has arrived so far and stop."""
    start_append(spark, source, target, state, rejects, availableNow=True).awaitTermination()
