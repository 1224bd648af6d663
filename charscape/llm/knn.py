"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

1. A bounded sample of labelled training rows is drawn by hash (`Settings.sample`, in expectation).
2. A text's terms are sequences of three character classes (runs of letters keep their lengths only up
   to three), and how often its words repeat; counts are damped and weighted by inverse document
   frequency. Terms are few (4096) and fixed, so vectors have a bounded size.
3. A truncated singular value decomposition of the sample gives the latent space. Sample vectors and
   the projection are broadcast; their size is bounded by the sample and the rank, not by the data.
4. Every document, whole text, is projected, and its cosines with all sample vectors are computed
   exactly, in blocks of documents. The `neighbours` most similar rows vote with weights that grow
   with similarity; the score is the weighted share of label 1.

Defined cases: NULL and empty texts have no terms and get the share of label 1 in the sample; a
sample without rows gives 0.5; rows that repeat get equal scores; ties of similarity at the edge of the
neighbourhood go to the earlier sample row; labels that are NULL are not used. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import small_batches

TERMS = 4096
EXTRA = 64  # the last terms count repetition
CHUNK = 512


@dataclass(frozen=True)
class Settings:
    sample: int = 3000
    rank: int = 48
    neighbours: int = 25
    power: float = 4.0


def _classes() -> np.ndarray:
    """A class from 0 to 14 for every byte; 15 marks a letter run's third letter and later."""
    table = np.full(256, 14, np.int64)
    for number, chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n",
        b".,", b"!?", b";:", b"'\"-()", b"#", b"*$", b"%", b"&<>", b"|")):
        table[list(chars)] = number
    table[128:] = 0
    return table


CLASSES = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """Damped counts of a text's terms."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    kinds = CLASSES[data]
    if len(kinds) > 2:
        inner = (kinds[2:] == kinds[1:-1]) & (kinds[2:] == kinds[:-2]) & (kinds[2:] < 2)
        keep = np.concatenate([[True, True], ~inner])
        kinds = kinds[keep]
    if len(kinds) > 2:
        codes = kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:]
        out += np.bincount(codes % (TERMS - EXTRA), minlength=TERMS)
    total = max(1.0, float(len(kinds)))
    out = np.log1p(out * (1000.0 / total))
    tokens = text.split()
    if tokens:
        share = 1 - len(set(tokens)) / len(tokens)
        pairs = list(zip(tokens, tokens[1:], strict=False))
        again = 1 - len(set(pairs)) / len(pairs) if pairs else 0.0
        lines = text.split("\n")
        same = 1 - len(set(lines)) / len(lines)
        length = min(15, int(np.log2(len(tokens))))
        for at, value in enumerate((share, again, same)):
            out[TERMS - EXTRA + 16 * at + int(value * 15)] = 6.0
        out[TERMS - 16 + length] = 3.0
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by term
    axes: np.ndarray  # terms x rank
    points: np.ndarray  # sample x rank, of length 1
    labels: np.ndarray
    prior: float


def sampled(labelled: DataFrame, size: int, key: Column) -> DataFrame:
    """About `size` rows, all if there are fewer, chosen by a hash of the key."""
    total = labelled.count()
    if total <= size:
        return labelled
    limit = int(size / total * 2**32)
    return labelled.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**32)) < limit)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """`labelled`: doc_id, text, label (0 or 1), training rows only."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [term_counts(t) for t in batch["text"].to_pylist()]
            hits = [np.flatnonzero(v) for v in vectors]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "terms": pa.array([h.astype(np.int16) for h in hits], pa.list_(pa.int16())),
                "values": pa.array([v[h] for v, h in zip(vectors, hits, strict=True)],
                                   pa.list_(pa.float32()))})

    known = labelled.where("label is not null").select(
        "doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = sampled(small_batches(known), settings.sample, F.col("doc_id")).mapInArrow(
        sparse, "doc_id long, label int, terms array<short>, values array<float>"
    ).toArrow().sort_by([("doc_id", "ascending")]).to_pydict()
    n = len(rows["label"])
    labels = np.array(rows["label"], np.float64)
    counts = np.zeros((n, TERMS), np.float32)
    for i, (terms, values) in enumerate(zip(rows["terms"], rows["values"], strict=True)):
        counts[i, terms] = values
    weights = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    if n == 0:
        return Model(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    matrix = unit(counts * weights)
    rank = min(settings.rank, n)
    # Truncated decomposition by subspace iteration from fixed starting vectors.
    space = np.random.default_rng(0).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(6):
        space, _ = np.linalg.qr(matrix.T @ (matrix @ space))
    _, values, turn = np.linalg.svd(matrix @ space, full_matrices=False)
    axes = (space @ turn.T[:, :rank]).astype(np.float32)
    return Model(weights, axes, unit(matrix @ axes), labels, float(labels.mean()))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def votes(model: Model, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """Scores of rows of term counts."""
    if not len(model.points):
        return np.full(len(counts), model.prior)
    place = unit(unit(counts * model.weights) @ model.axes)
    near = place @ model.points.T
    k = min(settings.neighbours, near.shape[1])
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6).astype(np.float64) ** settings.power
    score = (weight * model.labels[best]).sum(1) / weight.sum(1)
    return np.where(counts.any(1), score, model.prior)


def scored(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                counts = np.stack([term_counts(t) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"],
                    "score": np.clip(votes(shared.value, counts, settings), 0.0, 1.0)})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double")
