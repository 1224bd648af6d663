"""A corpus pipeline: documents in, token ids of the training mix out.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but
the last return the columns of `documents`; each result is written to the shared folder and read again.
What a stage has written besides, and its input, is deleted as soon as its result is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.llm import bpe, minhash, mixing, quality, suffix
from charscape.llm.common import discard, scratch, table
from charscape.llm.queries import tokenizer_path
from charscape.sources.workspace import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence limits."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.representatives(docs, minhash.Settings(words=5, percent=80))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id has as well."""
    return suffix.shortened(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix draws, shuffled within its shards."""
    return mixing.mixed(docs, docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text, by drawn copy."""
    path = tokenizer_path()
    return bpe.decoded(bpe.encoded(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("text"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("source_mix", source_mix),
    ("bpe_token_ids", token_ids),
]

# The last stage, a tokenizer, has no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        discard(last)
        docs = last = spark.read.schema(result.schema).parquet(path)
    return docs
