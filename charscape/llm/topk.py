"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks: vectors are packed into block rows of
integers, and each block of candidates meets each block of queries in one matrix product. No score is
stored. Instead, rounds of histograms find each query's kth highest score:

1. A histogram covers the range in which the kth score lies; each round divides that range by 256.
   A task adds up the scores of its block pair per query and bin; bins below the one that holds the
   block's own kth score cannot hold the global one and are not sent. Counts are summed by query and
   bin, and the bin that holds the kth score becomes the next range, until it is one value wide.
2. Scores above the kth value are kept, fewer than k; of those equal to it, each block pair sends
   at most its k smallest ids. The last ranking orders by score and id.

What a query sends is bounded by k and 256 per block pair, however many candidates tie.

Defined cases: vectors that are NULL, empty, or hold a NULL or non-finite component take no part, nor
do rows without an id; a query meets candidates of its own number of components; a candidate with the
query's id is the query itself; rows that repeat an id are candidates of their own, and each is a
query of its own; with fewer than k candidates all are returned; no queries, no rows. Scores are
exact 64-bit integers; a score that could leave that range raises an error. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charscape.llm.common import materialise, small_batches

BLOCK = 4096
CHUNK = 256
BINS = 256
BLOCK_SCHEMA = "block string, dims int, size int, top double, ids binary, data binary"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and components floor(scale * x) as integers, of the vectors that take part."""
    x = F.col("embedding")
    sound = (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("codes"),
    )


def blocks(coded: DataFrame) -> DataFrame:
    """Vectors packed into rows of up to BLOCK vectors with one number of components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dims: int) -> pa.RecordBatch:
            parts = waiting.pop(dims)
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            top = float(np.abs(data.astype(np.float64)).max())
            return pa.RecordBatch.from_pydict({
                "block": [uuid.uuid4().hex], "dims": pa.array([dims], pa.int32()),
                "size": pa.array([len(ids)], pa.int32()), "top": [top],
                "ids": [ids.tobytes()], "data": [data.tobytes()]})

        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            column = batch["codes"]
            ends = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(ends)])
            for dims in np.unique(ends):
                rows = np.flatnonzero(ends == dims)
                matrix = flat[starts[rows][:, None] + np.arange(dims)]
                waiting.setdefault(int(dims), []).append((ids[rows], matrix))
                if sum(len(p[0]) for p in waiting[int(dims)]) >= BLOCK:
                    yield row(int(dims))
        for dims in list(waiting):
            yield row(dims)

    return coded.mapInArrow(pack, BLOCK_SCHEMA)


def products(queries: np.ndarray, candidates: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; `exact` says that doubles hold every partial sum."""
    if exact:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def scored(pairs_row: dict, exact: bool) -> Iterator[tuple]:
    """(query positions, query ids, candidate ids, scores, own mask) of a block pair, in chunks."""
    dims = pairs_row["dims"]
    q_ids = np.frombuffer(pairs_row["q_ids"], np.int64)
    c_ids = np.frombuffer(pairs_row["ids"], np.int64)
    q = np.frombuffer(pairs_row["q_data"], np.int64).reshape(-1, dims)
    c = np.frombuffer(pairs_row["data"], np.int64).reshape(-1, dims)
    for at in range(0, len(q), CHUNK):
        part = q[at:at + CHUNK]
        own = q_ids[at:at + CHUNK, None] == c_ids[None, :]
        yield np.arange(at, at + len(part)), q_ids[at:at + CHUNK], c_ids, products(part, c, exact), own


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query, ties to the smaller id."""
    spark = vectors.sparkSession
    coded = quantised(vectors, scale)
    small_batches(coded)
    candidates = materialise(blocks(coded), "topk-candidates")
    queries = materialise(blocks(coded.where(is_query)), "topk-queries").select(
        F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"))
    bound = candidates.agg(F.max(F.col("top") * F.col("top") * F.col("dims"))).first()[0]
    if bound is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if bound >= 2.0**62:
        raise ArithmeticError("scores could leave the range of 64-bit integers")
    exact = bound < 2.0**52
    reach = int(bound)

    # Each candidate block is sent to every query block of its number of components.
    addresses = queries.groupBy("dims").agg(F.collect_list("q_block").alias("q_blocks"))
    sent = candidates.join(addresses, "dims").withColumn("q_block", F.explode("q_blocks")).select(
        "q_block", "block", "dims", "ids", "data")

    def pairs(state: DataFrame) -> DataFrame:
        return sent.join(queries.drop("dims").join(state, "q_block"), "q_block").repartition(
            max(spark.sparkContext.defaultParallelism, 8), "q_block", "block")

    width = 1
    while width * BINS < 2 * reach + 1:
        width *= BINS
    state = queries.select(
        "q_block", F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("need"))
    while True:
        state = _next_state(pairs(state), k, width, reach, exact)
        if width == 1:
            break
        width //= BINS
    found = pairs(state).mapInArrow(
        _selector(k, exact), "q_block string, position int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "position").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _next_state(pairs: DataFrame, k: int, width: int, reach: int, exact: bool) -> DataFrame:
    """One round: the bin of every query's kth score, as (low, need) arrays per query block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = len(row["q_ids"]) // 8
                lows = (np.full(size, -reach, np.int64) if row["low"] is None
                        else np.frombuffer(row["low"], np.int64))
                needs = (np.full(size, k, np.int64) if row["need"] is None
                         else np.frombuffer(row["need"], np.int64))
                for at, _, _, scores, own in scored(row, exact):
                    low = lows[at][:, None]
                    bins = (scores - low) // width
                    inside = (bins >= 0) & (bins < BINS) & ~own
                    flat = (np.arange(len(at))[:, None] * BINS + bins)[inside]
                    counts = np.bincount(flat, minlength=len(at) * BINS).reshape(len(at), BINS)
                    # Suffix sums: a bin matters while fewer than `need` scores lie above it.
                    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                    position, bin_no = np.nonzero((counts > 0) & (above < needs[at][:, None]))
                    if not len(position):
                        position, bin_no = np.array([0]), np.array([0])
                    yield pa.RecordBatch.from_pydict({
                        "q_block": [row["q_block"]] * len(position),
                        "size": pa.array([size] * len(position), pa.int32()),
                        "position": at[position].astype(np.int32),
                        "low": lows[at[position]], "need": needs[at[position]],
                        "bin": bin_no.astype(np.int32), "n": counts[position, bin_no]})

    bins = pairs.mapInArrow(
        count, "q_block string, size int, position int, low long, need long, bin int, n long")
    down = Window.partitionBy("q_block", "position").orderBy(F.desc("bin"))
    summed = (
        bins.groupBy("q_block", "size", "position", "low", "need", "bin").agg(F.sum("n").alias("n"))
        .withColumn("above", F.sum("n").over(down) - F.col("n"))
        .withColumn("least", F.min("bin").over(Window.partitionBy("q_block", "position")))
    )
    # The kth score's bin; a query with fewer than k candidates takes all of them.
    hit = (F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))
    short = (F.col("bin") == F.col("least")) & (F.col("above") + F.col("n") < F.col("need"))
    chosen = summed.where(hit | short).select(
        "q_block", "size", F.struct(
            "position",
            F.when(short, F.lit(-reach).cast("long")).otherwise(
                F.col("low") + F.col("bin").cast("long") * F.lit(width).cast("long")).alias("low"),
            F.when(short, F.lit(2 * k).cast("long")).otherwise(
                F.col("need") - F.col("above")).alias("need"),
        ).alias("s"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = np.full(row["size"], -reach, np.int64)
                need = np.full(row["size"], 2 * k, np.int64)
                for s in row["states"]:
                    low[s["position"]], need[s["position"]] = s["low"], s["need"]
                yield pa.RecordBatch.from_pydict({
                    "q_block": [row["q_block"]], "low": [low.tobytes()], "need": [need.tobytes()]})

    # At most BLOCK entries for a query block.
    state = chosen.groupBy("q_block", "size").agg(F.collect_list("s").alias("states")).mapInArrow(
        gather, "q_block string, low binary, need binary")
    return materialise(state, "topk-state")


def _selector(k: int, exact: bool):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lows = np.frombuffer(row["low"], np.int64)
                for at, q_ids, c_ids, scores, own in scored(row, exact):
                    low = lows[at][:, None]
                    over_q, over_c = np.nonzero((scores > low) & ~own)
                    tie_q, tie_c = np.nonzero((scores == low) & ~own)
                    order = np.lexsort((c_ids[tie_c], tie_q))
                    tie_q, tie_c = tie_q[order], tie_c[order]
                    first = np.searchsorted(tie_q, tie_q, side="left")
                    near = np.arange(len(tie_q)) - first < k
                    q = np.concatenate([over_q, tie_q[near]])
                    c = np.concatenate([over_c, tie_c[near]])
                    if len(q):
                        yield pa.RecordBatch.from_pydict({
                            "q_block": [row["q_block"]] * len(q), "position": at[q].astype(np.int32),
                            "query_id": q_ids[q], "vec_id": c_ids[c], "score": scores[q, c]})

    return select
