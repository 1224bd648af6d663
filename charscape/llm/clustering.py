"""Centroid clustering of integer vectors, with Ptolemaic bounds from fixed pivots.

For four points Ptolemy's inequality gives d(x,c) * d(p,q) >= |d(x,p) * d(c,q) - d(x,q) * d(c,p)|. The
pivots p and q never move, so every vector's distances to them are computed once and stored with it; the
centroids' distances to them are a few numbers per round. The greatest bound over all pairs of pivots
says which centroids cannot be nearest:

1. Vectors are packed into blocks of integers with the distances to the pivots and written once.
2. A round reads the blocks. Each vector's centroid of the least bound is measured exactly; centroids whose
   bound, rounded towards zero by more than its floating-point error, lies above that distance are out;
   the survivors are measured exactly, in 64-bit integers, and ties go to the smaller number.
3. A task sends one row of sums per centroid. Spark adds them up; the driver gets one row per
   centroid and takes the exact floor of sum / count.

What is sent to tasks is `clusters` vectors and `pivots` numbers for each. The number of pivots does not
change a result, only how many centroids are measured.

Defined cases: vectors that are NULL, of another length, or hold a NULL or non-finite component take no
part; a row without an id is clustered but never starts a centroid; rows that repeat an id are vectors of
their own (as starts they come in the order of their components); with fewer vectors than clusters every
vector starts one; without vectors the result is empty; an empty centroid stays where it is. Components
beyond 2**26 raise an error, since squares could leave 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import materialise, small_batches

BLOCK = 4096
REACH = 1 << 26
SLACK = 16 * np.finfo(np.float64).eps  # over the error of a bound's few operations


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    pivots: int = 5


def coded(vectors: DataFrame, settings: Settings) -> DataFrame:
    """vec_id and components floor(scale * x) of the vectors that take part."""
    x = F.col("embedding")
    sound = (F.size(x) == settings.dims) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(float(settings.scale)) * v.cast("double"))).alias("codes"))


def starts(codes: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in order: at most `clusters` rows."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = codes.where(F.col("vec_id").isNotNull()).orderBy(digest, "codes").limit(
        settings.clusters).select("codes").collect()
    return np.array([r["codes"] for r in rows], np.int64).reshape(-1, settings.dims)


def spread_pivots(centroids: np.ndarray, count: int) -> np.ndarray:
    """Distinct starting centroids, each as far as possible from those chosen before."""
    chosen = [0]
    far = ((centroids - centroids[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((centroids - centroids[chosen[-1]]) ** 2).sum(axis=1))
    return centroids[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points (rows) to pivots (columns); the squares are exact."""
    out = np.empty((len(points), len(pivots)))
    for j, pivot in enumerate(pivots):
        out[:, j] = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    return out


def lower_bounds(x: np.ndarray, c: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Bounds of the squared distance of every point to every centroid, never above it.

    x, c: distances of points and centroids to the pivots; between: among the pivots.
    """
    best = np.zeros((len(x), len(c)))
    for p in range(x.shape[1]):
        for q in range(p):
            one = x[:, p, None] * c[None, :, q]
            two = x[:, q, None] * c[None, :, p]
            low = (np.abs(one - two) - SLACK * (one + two)) / between[p, q]
            np.maximum(best, low, out=best)
    return best * best * (1 - SLACK)


def nearest(points: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance, and how many distances were measured."""
    bounds = lower_bounds(cached, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))
    cluster = bounds.argmin(axis=1)
    least = ((points - centroids[cluster]) ** 2).sum(axis=1)
    measured = len(points)
    # Converted to doubles a distance may round down; the slack keeps that from cutting a tie.
    open_ = bounds <= (least * (1 + SLACK))[:, None]
    open_[np.arange(len(points)), cluster] = False
    for number in range(len(centroids)):
        rows = np.flatnonzero(open_[:, number])
        if not len(rows):
            continue
        measured += len(rows)
        found = ((points[rows] - centroids[number]) ** 2).sum(axis=1)
        better = (found < least[rows]) | ((found == least[rows]) & (number < cluster[rows]))
        cluster[rows[better]], least[rows[better]] = number, found[better]
    return cluster, least, measured


def blocks(codes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """ids, components and distances to the pivots, in rows of up to BLOCK vectors."""
    dims = pivots.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = part["codes"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if len(points) and max(-int(points.min()), int(points.max())) > REACH:
                    raise ArithmeticError("components could leave the range of 64-bit distances")
                ids = part["vec_id"]
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "data": [points.astype(np.int32).tobytes()],
                    "cached": [pivot_distances(points, pivots).tobytes()]})

    return codes.mapInArrow(pack, "ids array<long>, data binary, cached binary")


def _read(batches: Iterator[pa.RecordBatch], dims: int, pivots: int):
    for batch in batches:
        for ids, data, cached in zip(batch["ids"], batch["data"], batch["cached"], strict=True):
            yield (ids.values, np.frombuffer(data.as_buffer(), np.int32).reshape(-1, dims).astype(np.int64),
                   np.frombuffer(cached.as_buffer(), np.float64).reshape(-1, pivots))


def moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    count, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = np.zeros(count, np.int64), np.zeros((count, dims), np.int64)
        for _, points, cached in _read(batches, dims, len(pivots)):
            cluster, _, _ = nearest(points, cached, centroids, pivots)
            sizes += np.bincount(cluster, minlength=count)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            sums[present] += np.add.reduceat(points[order], first, axis=0)
        held = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict({
            "cluster": held.astype(np.int32), "n": sizes[held],
            "sums": pa.array(list(sums[held]), pa.list_(pa.int64()))})

    parts = stored.mapInArrow(add, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    out = centroids.copy()
    for row in totals.collect():  # one row per centroid
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def spelled(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clustered(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid, centroid_sha256."""
    spark = vectors.sparkSession
    codes = coded(small_batches(vectors, BLOCK), settings)
    centroids = starts(codes, settings)
    if not len(centroids):
        # Without ids nothing starts a centroid, and nothing can be assigned.
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_size long, cluster_inertia long, "
                "inertia long, centroid array<long>, centroid_sha256 string")
    pivots = spread_pivots(centroids, settings.pivots)
    stored = materialise(blocks(codes, pivots), "cluster-blocks")
    for _ in range(settings.rounds):
        centroids = moved(stored, centroids, pivots)
    dims, width = centroids.shape[1], len(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, cached in _read(batches, dims, width):
            cluster, distance, _ = nearest(points, cached, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])

    assigned = materialise(
        stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "cluster-members")
    totals = assigned.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"), F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in totals)
    described = [(r["cluster"], r["cluster_size"], r["cluster_inertia"], inertia,
                  [int(x) for x in centroids[r["cluster"]]], spelled(centroids[r["cluster"]]))
                 for r in totals]
    clusters = spark.createDataFrame(
        described, "cluster int, cluster_size long, cluster_inertia long, inertia long, "
                   "centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(  # a row per centroid
        "vec_id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid",
        "centroid_sha256")
