"""Registered queries: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.llm import (
    alignment, bpe, clustering, html, knn, minhash, mixing, quality, sharding, suffix, topk, toxicity, warc)
from charscape.llm.common import in_training, table
from charscape.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _training(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """doc_id, text, label of the rows that a model may learn from."""
    labels = table(spark, sf_dir, "labels").where(in_training(F.col("doc_id"))).select(
        F.col("doc_id"), F.col(label).alias("label"))
    return table(spark, sf_dir, "documents").where(in_training(F.col("doc_id"))).select(
        "doc_id", "text").join(labels, "doc_id")


def _predicted(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), minhash.Settings(words=2, percent=80))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(_training(spark, sf_dir, "toxic"))
    return _predicted(toxicity.scored(table(spark, sf_dir, "documents"), lexicon), 0.7)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    tokens = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = knn.fit(_training(spark, sf_dir, "quality"))
    return _predicted(knn.scored(table(spark, sf_dir, "documents"), model), 0.5)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(
        table(spark, sf_dir, "embeddings"), clustering.Settings(clusters=16, rounds=3, dims=64, scale=64)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.located(table(spark, sf_dir, "documents"), sharding.Settings(shards=16))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(
        table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_minhash, op3_quality_rules, op4_exact_top_k, op5_toxicity, op6_html, op7_mixing, op8_bpe,
        op9_suffix_arrays, op10_quality_classifier, op11_clustering, op12_sharding, op13_alignment,
    )
}
