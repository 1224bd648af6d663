"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import discard, materialise

CHUNK = 1 << 18


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over some links: every node that is not its tree's least, with that least node."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[:len(a)].tolist(), flat[len(a):].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(names))], np.int64)
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def components(links: DataFrame, at_once: int = CHUNK) -> DataFrame:
    """(node, root) of all nodes in links (a, b): root is the component's least node.

    Tasks first shrink their links to trees by union-find. If at most `at_once` links are left, which is a few MB,
    one task joins these trees. Else, in rounds, every node's neighbours
    are attached to the least one around it, larger and smaller neighbours in turn, until each
    component is a star. A node's neighbours are only ever reduced to a minimum, never gathered.
    """

    def shrink(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        names = ("node", "root") if last else ("a", "b")
        a, b, held = [], [], 0

        def flush() -> pa.RecordBatch:
            child, root = _forest(np.concatenate(a), np.concatenate(b))
            if last:
                own = np.unique(root)
                child, root = np.concatenate([child, own]), np.concatenate([root, own])
            return pa.RecordBatch.from_pydict({names[0]: child, names[1]: root})

        for batch in batches:
            a.append(batch["a"].to_numpy())
            b.append(batch["b"].to_numpy())
            held += batch.num_rows
            if held >= CHUNK and not last:
                yield flush()
                a, b, held = [], [], 0
        if held:
            yield flush()

    # In every row, b is smaller than a.
    edges = materialise(links.where("a <> b").select("a", "b").mapInArrow(shrink, "a long, b long"), "components")
    if edges.count() <= at_once:
        return edges.coalesce(1).mapInArrow(lambda batches: shrink(batches, True), "node long, root long")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(
            least.select("a", F.least("a", "m").alias("m")), "a")
        # v > a: v's new neighbour is the least node around a.
        stars = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = stars.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = stars.join(low, "a")
        after = materialise(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        # Stars: every node has one smaller neighbour, and no root has one.
        many = after.groupBy("a").count().where("count > 1").select("a").limit(1)
        inner = after.select("b").join(after.select("a"), F.col("a") == F.col("b"), "left_semi").limit(1)
        discard(edges)
        edges = after
        if many.isEmpty() and inner.isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
