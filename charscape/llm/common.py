"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.sources.workspace import new_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """The table, with the session set to hand at most so many rows at once to Python: texts are long,
    and both the JVM and the worker hold a whole batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it: computed once, and safe from lost executors.
    Tables that carry whole texts are packed more tightly."""
    path = new_path(df.sparkSession, name)
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    (df.write.option("compression", "zstd") if texts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `materialise` has written and nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what `materialise` has written inside, also after an error. Results that are
    still to be read must have been written outside."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            _delete(spark, path)


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
