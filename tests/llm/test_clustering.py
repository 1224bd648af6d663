"""Centroid clustering against a plain version, and its bounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from charscape.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], clusters: int, rounds: int, dims: int, scale: int) -> list[tuple]:
    """(id, cluster, distance) of every vector and (cluster, centroid)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:clusters]]
    if not centroids:
        return [], []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c
                     for vs, c in zip(own, centroids, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def rows_of(seed: int, n: int, dims: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, dims))
    out = [(i, [float(x) for x in heads[i % 5] + rng.normal(size=dims) / 3], 0) for i in range(n)]
    out += [(n + i, out[0][1], 0) for i in range(n // 3)]  # one very common vector
    out += [(3, out[3][1], 1), (3, out[4][1], 1), (None, out[5][1], None), (n + 900, None, 0), (n + 901, [], 0),
            (n + 902, [1.0] * (dims - 1), 0), (n + 903, [None] + [1.0] * (dims - 1), 0),
            (n + 904, [float("nan")] + [1.0] * (dims - 1), 0), (n + 905, [float("inf")] * dims, 0)]
    return out


@pytest.mark.parametrize(("clusters", "pivots"), [(1, 5), (7, 2), (16, 5), (400, 4)])
def test_matches_a_plain_version(spark, clusters, pivots):
    rows = rows_of(clusters, 120, 6)
    chosen = clustering.Settings(clusters=clusters, rounds=3, dims=6, scale=8, pivots=pivots)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {c: F.lit("x") for c in ("cluster", "distance", "codes", "ids", "data")})
    got = clustering.clustered(df, chosen).collect()
    want, centroids = plain(rows, clusters, 3, 6, 8)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(want, key=key)
    total = sum(d for _, _, d in want)
    for r in got:
        assert list(r.centroid) == centroids[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
        assert r.inertia == total
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.cluster_size == sum(1 for _, c, _ in want if c == r.cluster)


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [-4, 0], [4, 0]])
    points = np.array([[0, 3], [4, 1], [-9, 0]])
    pivots = clustering.spread_pivots(centroids, 5)
    assert len(pivots) == 2
    cluster, distance, _ = clustering.nearest(
        points, clustering.pivot_distances(points, pivots), centroids, pivots)
    assert cluster.tolist() == [0, 0, 1]
    assert distance.tolist() == [25, 1, 25]


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 0)], [(None, [1.0] * 64, 0)]):
        assert clustering.clustered(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        clustering.clustered(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).count()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 64]), st.sampled_from([2, 100, 1 << 26]))
def test_bounds_never_exceed_the_distance(seed, dims, reach):
    rng = np.random.default_rng(seed)
    points = rng.integers(-reach, reach, (40, dims))
    centroids = np.concatenate([rng.integers(-reach, reach, (6, dims)), points[:3]])
    pivots = clustering.spread_pivots(centroids, 4)
    between = clustering.pivot_distances(pivots, pivots)
    low = clustering.lower_bounds(clustering.pivot_distances(points, pivots),
                                  clustering.pivot_distances(centroids, pivots), between)
    exact = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert all(int(math.floor(b)) <= e for b, e in zip(low.ravel().tolist(), exact.ravel().tolist(), strict=True))
    cluster, least, _ = clustering.nearest(
        points, clustering.pivot_distances(points, pivots), centroids, pivots)
    assert cluster.tolist() == exact.argmin(axis=1).tolist()
    assert least.tolist() == exact.min(axis=1).tolist()


def test_bounds_save_measurements():
    rng = np.random.default_rng(5)
    heads = rng.integers(-4000, 4000, (16, 64))
    points = heads[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 64))
    pivots = clustering.spread_pivots(heads, 5)
    _, _, measured = clustering.nearest(points, clustering.pivot_distances(points, pivots), heads, pivots)
    assert measured < 3000 * 16 / 2
