"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

1. A text becomes the set of its distinct word shingles, as 64-bit hashes, and a SuperMinHash
   signature: in step j every element gets a rank in [j, j + 1) at the j-th place of its own random
   permutation, and a text stops as soon as no later step can lower its signature.
2. Texts with equal sets are one node from here on, so copies cost nothing further.
3. Bands of the signature put nodes into buckets. In a bucket, all nodes are compared with a pivot, on
   full sets: first the one that shares most buckets with others, which is the original where others are
   its copies with changes. Nodes linked to it leave the bucket; by the triangle inequality of the Jaccard distance
   they can only be linked further to nodes at a middling distance from the pivot, and they are compared
   with those that share enough of the elements in which they differ from it (`around`). What is left of a
   bucket gets twice as many pivots in the next round.
   A bucket in which no pivot finds a link is settled at once: of the nodes that are not linked to its first
   pivot, those are compared that share enough of what they differ in from it (`beyond`).
4. Links are grouped by union-find inside tasks, then across them.

With 40 bands of 5 rows, a pair at the similarity limit of 0.8 misses all buckets with a probability
of 1.2e-7; every comparison is exact, and no bucket, group or number of partners is capped.

Defined cases: texts that are NULL or have no words have the empty set and stay alone; texts with fewer
words than a shingle have their whole sequence as only element; rows that repeat an id and a text are
all kept or all dropped by `groups`, and `representatives` keeps one of them; a row without an id joins
its group, is no group's smallest id, and is kept only if no row of its group has an id; an empty table
gives an empty result. Extra columns are ignored by `groups` and kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from charscape.llm import graph, hashing
from charscape.llm.common import discard, materialise, small_batches, tidy

CHUNK_BYTES = 1 << 20
ELEMENTS = 1 << 18  # handed on at once


@dataclass(frozen=True)
class Settings:
    words: int = 5  # words in a shingle
    percent: int = 80  # least similarity of linked texts
    bands: int = 40
    rows: int = 5

    @property
    def places(self) -> int:
        return self.bands * self.rows


# --- Sets and signatures ----------------------------------------------------------------------------


def chunks(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a text column with about CHUNK_BYTES each, at least one row."""
    ends = np.cumsum(np.array([len(t) if t is not None else 0 for t in column.to_pylist()]))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of texts, sorted."""
    raw, bounds = hashing.text_bytes(column)
    n = len(column)
    row_of = np.repeat(np.arange(n), np.diff(bounds))
    data = np.full(len(raw) + n, 32, np.uint8)  # a space behind every text
    data[np.arange(len(raw)) + row_of] = raw
    starts, ends = hashing.word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(bounds[:-1] + np.arange(n), starts, side="right") - 1
    word = hashing.spans(hashing.prefix_sums(data, fold_case=True), starts, ends)
    factor = hashing.powers(1024)[1:words + 1]
    counts = np.bincount(row, minlength=n)
    full = max(0, len(word) - words + 1)
    sums = np.zeros(full, np.uint64)
    for t in range(words):
        sums += word[t:t + full] * factor[t]
    inside = row[:full] == row[words - 1:words - 1 + full]
    rows, hashes = [row[:full][inside]], [hashing.mix(sums[inside])]
    first = np.cumsum(counts) - counts
    for length in range(1, words):  # short texts
        short = np.flatnonzero(counts == length)
        if len(short):
            total = np.full(len(short), length, np.uint64)
            for t in range(length):
                total += word[first[short] + t] * factor[t]
            rows.append(short)
            hashes.append(hashing.mix(total ^ np.uint64(hashing.BASE)))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray, n: int, places: int) -> np.ndarray:
    """SuperMinHash of n sets: ranks as (step << 32) + fraction."""
    out = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    kind = np.uint8 if places <= 256 else np.uint16
    order = np.tile(np.arange(places, dtype=kind), (len(row), 1))
    low = np.uint64(0xFFFFFFFF)
    for step in range(places):
        if not len(row):
            break
        draw = hashing.mix(value + np.uint64((step + 1) * hashing.BASE & hashing.MASK))
        other = step + ((draw & low) % np.uint64(places - step)).astype(np.int64)
        at = np.arange(len(row))
        place = order[at, other].copy()
        order[at, other] = order[:, step]
        rank = (np.uint64(step) << np.uint64(32)) + (draw >> np.uint64(32))
        np.minimum.at(flat, row * places + place, rank)
        # A text is done when each of its ranks is below the next step's.
        present = np.unique(row)
        open_rows = present[out[present].max(axis=1) >= np.uint64(step + 1) << np.uint64(32)]
        if len(open_rows) < len(present):
            still = np.zeros(n, bool)
            still[open_rows] = True
            keep = still[row]
            row, value, order = row[keep], value[keep], order[keep]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    shaped = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(hashing.mix(np.arange(1, bands + 1, dtype=np.uint64)),
                          shaped.shape[:2]).copy()
    for r in range(shaped.shape[2]):
        key = hashing.mix(key ^ shaped[:, :, r])
    return key.view(np.int64)


def set_keys(row: np.ndarray, value: np.ndarray, n: int) -> list[bytes | None]:
    """A 128-bit key of every set: sums of scrambled elements."""
    out: list[bytes | None] = [None] * n
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        one = np.add.reduceat(hashing.mix(value + np.uint64(1)), first)
        two = np.add.reduceat(hashing.mix(~value), first)
        for r, a, b in zip(row[first].tolist(), one.tolist(), two.tolist(), strict=True):
            out[r] = a.to_bytes(8, "little") + b.to_bytes(8, "little")
    return out


def sketched(docs: DataFrame, settings: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set_key, bands of every document, and the carried columns as `doc`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       *([F.struct(*[F.col(c) for c in carry]).alias("doc")] if carry else []))
    out = StructType.fromDDL("doc_id long, n_shingles long, set_key binary, bands array<long>")
    if carry:
        out = out.add("doc", rows.schema["doc"].dataType)

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch["text"]):
                n = len(part)
                row, value = shingle_sets(part, settings.words)
                keys = set_keys(row, value, n)
                bands = band_keys(signatures(row, value, n, settings.places), settings.bands)
                flat = pa.array(bands.reshape(-1), pa.int64())
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * settings.bands)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].slice(at, n),
                    "n_shingles": pa.array(np.bincount(row, minlength=n), pa.int64()),
                    "set_key": pa.array(keys, pa.binary()),
                    "bands": pa.ListArray.from_arrays(offsets, flat),
                    **({"doc": batch["doc"].slice(at, n)} if carry else {})})
                at += n

    return small_batches(rows).mapInArrow(sketch, out)


# --- Links -----------------------------------------------------------------------------------------


def node_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node, elements (sorted hashes) of wanted nodes, from their smallest document's text."""

    @tidy
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch["text"]):
                n = len(part)
                row, value = shingle_sets(part, settings.words)
                ends = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_pydict({
                    "found_key": pa.array(set_keys(row, value, n), pa.binary()),
                    "elements": pa.array([value[a:b].tobytes() for a, b in zip(ends, ends[1:],
                                                                               strict=False)],
                                         pa.binary())})
                at += n

    reps = wanted.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    found = texts.mapInArrow(expand, "found_key binary, elements binary")
    return wanted.join(found, F.col("set_key") == F.col("found_key")).select(
        "node", "elements").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, the exact sizes of intersection and union of their sets, and the size of b's. If pairs have a `reach`, also `only`: the
    elements that one of the sets has, for pairs at no larger distance, else NULL."""
    reaching = [c for c in pairs.columns if c == "reach"]

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = batch["reach"].to_pylist() if reaching else []
            shared, union, sizes, only = [], [], [], []
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                apart = np.setxor1d(p, q, assume_unique=True)
                shared.append((len(p) + len(q) - len(apart)) // 2)
                union.append(shared[-1] + len(apart))
                sizes.append(len(q))
                if reaching:
                    only.append(apart.tobytes() if len(apart) <= reach[i] * union[-1] else None)
            yield pa.RecordBatch.from_pydict({
                "a": batch["a"], "b": batch["b"], "shared": pa.array(shared, pa.int64()),
                "union": pa.array(union, pa.int64()),
                "b_size": pa.array(sizes, pa.int64()),
                **({"only": pa.array(only, pa.binary())} if reaching else {})})

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.select("a", "b", *reaching).join(left, "a").join(right, "b").mapInArrow(
        compare, "a long, b long, shared long, union long, b_size long" + (", only binary" if reaching else ""))


def spread(pairs: DataFrame) -> DataFrame:
    """The pairs with all their columns but `only`, once for every `element` of it."""
    schema = pairs.drop("only").schema

    @tidy
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = batch.drop_columns(["only"])
            rows, found, held = [], [], 0
            for i, only in enumerate(batch["only"]):
                elements = np.frombuffer(only.as_buffer(), np.int64)
                rows.append(np.full(len(elements), i))
                found.append(elements)
                held += len(elements)
                if held >= ELEMENTS or i == batch.num_rows - 1:
                    yield facts.take(pa.array(np.concatenate(rows))).append_column(
                        "element", pa.array(np.concatenate(found)))
                    rows, found, held = [], [], 0

    return pairs.select(*schema.names, "only").mapInArrow(part, schema.add("element", "long"))


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with all their columns, once for every `element` that only one of the sets of a and b has."""
    parts = compared(pairs.select("a", "b", F.lit(1.0).alias("reach")), sets)
    return spread(pairs.join(parts.select("a", "b", "only"), ["a", "b"]))


def around(pairs: DataFrame, limit: float) -> DataFrame:
    """What `sharing` needs to find links between nodes b that are linked to a pivot a and those at a middling
    distance from it.

    Let A and B be the elements in which a linked node and another one differ from the pivot; the two differ in
    those that are in one of A and B. As the other exceeds the limit with the pivot by `excess` elements, a link
    takes (2 - limit) * |A and B| >= excess + (1 - limit) * |A|: what the pivot's copies have in common with the
    pivot does not count.
    """
    need = F.when(F.col("linked"), (1 - limit) * F.col("size")).otherwise(F.col("excess")) / (2 - limit)
    return pairs.withColumns({
        "apart": F.lit(False), "left": F.col("linked"), "right": ~F.col("linked"), "need": need,
        "least": F.when(F.col("linked"), need).otherwise(F.col("excess"))})


def beyond(pairs: DataFrame, limit: float) -> DataFrame:
    """What `sharing` needs to find links among nodes b that are not linked to a pivot a.

    With A, B as above, a link takes |A and B| >= h(a) + h(b), where h(a) = (|A| - c * |a|) / 2 and
    c = limit / (2 - limit); as neither is linked to the pivot p, each h exceeds c * |p| / 2.
    """
    c, n = limit / (2 - limit), F.col("b_size")
    h = (F.col("size") - c * n) / 2
    # union + shared is the size of both sets.
    return pairs.withColumns({
        "apart": F.lit(True), "left": F.lit(True), "right": F.lit(True), "need": h,
        "least": h + c * (F.col("union") + F.col("shared") - n) / 2})


def sharing(parted: DataFrame) -> DataFrame:
    """(a, b) of all left and right nodes that share as many elements as both need, around one pivot.

    A row is an `element` in which node b differs from pivot a, in `size` elements in all; with any other node, at
    least `least` must be shared. Elements are ordered by the number of pairs they make, and common ones cannot be
    more than those from the first one on, in either set: copies with changes of their own, which share what they
    lack of the pivot, are joined by rare elements only.
    """
    sided = parted.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "apart", "left", "right", "size",
                          "need", "least", "element")
    key = ["pivot", "apart", "element"]
    counts = sided.groupBy(*key).agg(
        (F.count_if("left") * F.count_if("right") - F.count_if(F.col("left") & F.col("right"))).alias("pairs"))
    place = F.row_number().over(Window.partitionBy("pivot", "apart", "node").orderBy("pairs", "element"))
    # `rest`: elements from this one on.
    # Written, as both sides of the join read it.
    placed = materialise(sided.join(counts, key).withColumn("rest", F.col("size") - place + 1).where(
        (F.col("pairs") > 0) & (F.col("rest") >= F.col("least") - 1e-6)).select(
        *key, "node", "left", "right", "rest", "need"), "minhash-placed")
    x, y = (placed.where(side).select(*key, F.col("node").alias(n), F.col("rest").alias(f"{n}_rest"),
                                      F.col("need").alias(f"{n}_need"))
            for n, side in (("a", "left"), ("b", "right")))
    return x.join(y, key).where(
        F.when(F.col("apart"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
        & (F.least("a_rest", "b_rest") >= F.col("a_need") + F.col("b_need") - 1e-6)
    ).select("a", "b").distinct()


def likely(parted: DataFrame, limit: float) -> DataFrame:
    """(a, b) of all nodes a linked to a pivot and b at a middling distance from it that can be linked."""
    return sharing(around(parted, limit))


def linked_nodes(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame | None:
    """(node, root) of all nodes with links; None without any candidate."""
    limit = 1 - settings.percent / 100
    is_link = 100 * F.col("shared") >= settings.percent * F.col("union")
    members = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "minhash-sizes")
    met = members.join(sizes, "band")
    central = met.groupBy("node").agg(F.sum("n").alias("central"))
    active = materialise(met.drop("n").join(central, "node"), "minhash-buckets")
    discard(sizes)
    wanted = active.select("node").distinct().join(nodes, "node").select("node", "set_key", "rep")
    sets = materialise(node_sets(docs, wanted, settings), "minhash-sets")
    roots: DataFrame | None = None
    pivots_each = 1

    def joined(links: DataFrame) -> DataFrame:
        """The roots after more links; the roots so far stand for all links before."""
        old = roots
        if old is not None:
            links = links.unionByName(old.select(F.col("node").alias("a"), F.col("root").alias("b")))
        after = materialise(graph.components(links), "minhash-roots")
        discard(old)
        return after

    while True:
        if roots is None:
            placed = active.withColumn("root", F.col("node"))
        else:
            placed = active.join(roots, "node", "left").withColumn(
                "root", F.coalesce("root", "node"))
        # Buckets of one component need nothing more.
        open_buckets = placed.groupBy("band").agg(
            F.count("*").alias("n"), F.max(F.struct("central", "node"))["node"].alias("first"),
            F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").drop("r0", "r1")
        chance = (pivots_each - 1) / F.col("n")
        drawn = F.pmod(F.xxhash64("node", "band"), F.lit(1 << 40)) < chance * float(1 << 40)
        work = materialise(
            placed.join(open_buckets, "band")
            .withColumn("is_first", F.col("node") == F.col("first"))
            .withColumn("is_pivot", F.col("is_first") | drawn)
            .select("band", "node", "n_shingles", "central", "root", "is_pivot", "is_first"), "minhash-work")
        discard(active)
        if work.isEmpty():
            discard(work)
            break
        pivot = work.where("is_pivot").select(
            "band", F.col("node").alias("a"), F.col("root").alias("pivot_root"),
            F.col("n_shingles").alias("pivot_n"), "is_first")
        # The first pivot meets all. For the others, sizes bound the distance from below; beyond twice the
        # limit nothing depends on it.
        near = F.least("n_shingles", "pivot_n") >= (1 - 2 * limit - 1e-9) * F.greatest(
            "n_shingles", "pivot_n")
        meets = work.drop("is_first").withColumnRenamed("node", "b").join(pivot, "band").where(
            (F.col("b") != F.col("a"))
            & (F.col("is_first") | ((F.col("root") != F.col("pivot_root")) & near))
            & (~F.col("is_pivot") | (F.col("b") > F.col("a")))
        ).withColumn("foreign", F.col("root") != F.col("pivot_root"))
        # What the nodes of a bucket differ in from its first pivot can be needed at any distance.
        reach = F.when(F.max("is_first"), 1.0).otherwise(2 * limit + 1e-9)
        measured = materialise(
            compared(meets.groupBy("a", "b").agg(reach.alias("reach")), sets)
            .withColumn("size", F.col("union") - F.col("shared")).withColumn("linked", is_link), "minhash-pairs")
        seen = materialise(
            meets.select("band", "a", "b", "n_shingles", "central", "is_first", "is_pivot", "foreign")
            .join(measured.select("a", "b", "linked"), ["a", "b"]), "minhash-seen")
        discard(work)
        pivots_each *= 2
        new = measured.where("linked").select("a", "b")
        linked = not new.isEmpty()
        if linked:
            roots = joined(new)

        # Buckets in which no pivot has a link are settled by the differences from their first pivot.
        noisy = seen.where("foreign and linked").select("band").distinct()
        quiet = measured.join(seen.where("is_first and not is_pivot and not linked").join(
            noisy, "band", "left_anti"), ["a", "b"], "left_semi")
        crowd = quiet.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        facts = beyond(quiet.join(crowd, "a", "left_semi"), limit)
        columns = ["a", "b", "apart", "left", "right", "size", "need", "least", "only"]
        sided = facts.select(*columns)
        middling = None
        if linked:
            # Nodes at a middling distance of a pivot that are still not connected to it, and its linked nodes.
            known = roots.select(F.col("node").alias("key"), "root")
            within = measured.where(F.col("size") <= (2 * limit + 1e-9) * F.col("union")).withColumn(
                "excess", F.col("size") - limit * F.col("union"))
            middling = materialise(
                within.where(~F.col("linked"))
                .join(known.select(F.col("key").alias("a"), F.col("root").alias("p_root")), "a")
                .join(known.select(F.col("key").alias("b"), F.col("root").alias("y_root")), "b", "left")
                .where(F.col("p_root") != F.coalesce("y_root", "b"))
                .select(*within.columns), "minhash-middling")
            near_ones = within.where("linked").join(middling.select("a").distinct(), "a", "left_semi")
            sided = sided.unionByName(around(near_ones.unionByName(middling), limit).select(*columns))
        sided = materialise(sided, "minhash-differences")
        extra = None
        if not sided.isEmpty():
            found = sharing(spread(sided))
            extra = materialise(compared(found, sets).where(is_link).select("a", "b"), "minhash-extra")
            discard(found)
            if not extra.isEmpty():
                roots = joined(extra)
        active = materialise(
            seen.where("not is_pivot").groupBy("band", F.col("b").alias("node")).agg(
                F.first("n_shingles").alias("n_shingles"), F.first("central").alias("central"),
                F.max("linked").alias("gone")).where("not gone").drop("gone")
            .join(noisy, "band", "left_semi"), "minhash-buckets")
        discard(measured, seen, middling, sided, extra)
    discard(sets)
    return roots


def labelled(docs: DataFrame, settings: Settings, carry: tuple[str, ...] = ()
             ) -> tuple[DataFrame, DataFrame]:
    """The rows, with the carried columns as `doc` and a number `row`, and for each row: row, doc_id,
    n_shingles, component_id and its group (NULL for empty sets)."""
    rows = materialise(sketched(docs, settings, carry).withColumn(
        "row", F.monotonically_increasing_id()), "minhash-sketch", texts="text" in carry)
    nodes = materialise(
        rows.where("set_key is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
            F.first("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    roots = linked_nodes(docs, nodes, settings)
    named = nodes.select("set_key", "node", "rep")
    if roots is None:
        named = named.withColumns({"root": F.col("node"), "component_id": F.col("rep")})
    else:
        rooted = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    # Empty sets have no key: keys of their own spread them over the join's tasks.
    key = F.coalesce("set_key", F.col("row").cast("string").cast("binary"))
    joined = rows.select("row", "doc_id", "n_shingles", key.alias("set_key")).join(
        named.select("set_key", F.col("root").alias("group"), "component_id"), "set_key", "left")
    component = F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows, joined.select("row", "doc_id", "n_shingles", "group", component.alias("component_id"))


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return labelled(docs, settings)[1].select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group, with all columns of the documents: that with the smallest id, and among
    repeated rows any one. Rows with empty sets all stay."""
    columns = tuple(docs.columns)
    rows, labels = labelled(docs, settings, columns)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = labels.where("group is not null").groupBy("group").agg(F.min(order)["row"].alias("row"))
    stay = chosen.select("row").unionByName(labels.where("group is null").select("row"))
    return rows.join(stay, "row", "left_semi").select(
        *[F.col("doc").getField(c).alias(c) for c in columns])
