"""Removal of repeated substrings by suffix arrays over shards of shared text.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id.
All such strings are found, in these passes:

1. Documents are packed into blocks of about `block_bytes`, kept compressed in the shared folder.
2. Every `length`-byte string has a key, the least hash among its 16-byte substrings, so equal strings
   have equal keys. Consecutive strings with one key form a run. Blocks send their distinct keys,
   dealt evenly by hash, and learn which ones occur in more than one document; a key that all documents
   share is sent once per block. With each key goes the size of its distinct runs; a key whose runs
   have more than `crowded_bytes` (a phrase in many contexts, each run with its own surroundings) is
   crowded. The strings of its runs are keyed one by one, by their own hash, and asked for once more.
3. Runs with a shared key, and shared strings of crowded keys, are cut out as substrings, equal ones of
   a block once, and dealt by key into shards. All occurrences of a repeated string meet in one shard,
   as equal strings have equal keys and are crowded or not alike.
4. A shard's distinct substrings are sorted by induced sorting, but for those whose key no other distinct
   substring has. Permuted common prefixes of at least `length` mark neighbours with equal strings; each
   group of them has a least id.
5. Blocks get back the places where the least id is below a document's own, and cut them.

Blocks, key lists and shards have sizes that do not grow with the data, and copies shrink at each step,
so a third of all documents sharing one text is no larger group than any other.

Defined cases: NULL texts are empty; a NULL id is larger than any id; rows that repeat an id do not
count as smaller than each other, also if their texts are equal; a text shorter than `length` loses
nothing; an empty table gives an empty result. Extra columns are ignored, or carried by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from charscape.llm import hashing, induced
from charscape.llm.common import materialise, release, small_batches, tidy

GRAM = 16
PARTS = 8  # a shard's text is sorted in so many parts, to stay in the processor's caches
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    length: int = 50
    block_bytes: int = 2 << 20
    # Text bytes whose keys, or whose substrings, make up a shard.
    key_shard_bytes: int = 32 << 20
    text_shard_bytes: int = 1 << 20
    # Bytes of distinct runs beyond which a key does not stay in one shard.
    crowded_bytes: int = 4 << 20


# --- Blocks ------------------------------------------------------------------------------------------


def packed(rows: DataFrame, settings: Settings, rest: StructType | None) -> DataFrame:
    """block, n_bytes, ids, bounds, data (compressed bytes) and the rest of the columns, by block."""
    schema = StructType.fromDDL(
        "block string, n_bytes long, ids array<long>, bounds binary, data binary")
    if rest is not None:
        from pyspark.sql.types import ArrayType

        schema = schema.add("rest", ArrayType(rest))

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data, bounds = hashing.text_bytes(table["text"].combine_chunks())
            whole = pa.array([0, table.num_rows], pa.int32())
            columns = {
                "block": pa.array([uuid.uuid4().hex]), "n_bytes": pa.array([len(data)], pa.int64()),
                "ids": pa.ListArray.from_arrays(whole, table["doc_id"].combine_chunks()),
                "bounds": pa.array([bounds.tobytes()], pa.binary()),
                "data": pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary())}
            if rest is not None:
                columns["rest"] = pa.ListArray.from_arrays(whole, table["rest"].combine_chunks())
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            at, ends = 0, np.cumsum(hashing.text_bytes(batch["text"])[1][1:]
                                    - hashing.text_bytes(batch["text"])[1][:-1])
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                room = settings.block_bytes - size
                stop = max(at + 1, int(np.searchsorted(ends, base + room, side="right")))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1] - base)
                at = stop
                if size >= settings.block_bytes or at < batch.num_rows:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return small_batches(rows, 64).mapInArrow(pack, schema)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, bounds of its documents and their ids (NULL as the largest)."""
    data = np.frombuffer(zstandard.decompress(row["data"], max_output_size=max(1, row["n_bytes"])), np.uint8)
    bounds = np.frombuffer(row["bounds"], np.int64)
    ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
    return data, bounds, ids


# --- Keys --------------------------------------------------------------------------------------------


@dataclass
class Runs:
    """Maximal runs of strings with one key: first string, number of strings, key, document."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def find_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Runs:
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none.astype(np.uint64), none)
    least = hashing.least_grams(hashing.prefix_sums(data), GRAM, length - GRAM + 1)
    # Strings that lie inside one document.
    step = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(bounds) >= length)
    opens, closes = bounds[long], bounds[long + 1] - length + 1
    np.add.at(step, opens, 1)
    np.add.at(step, closes, -1)
    inside = np.cumsum(step[:len(least)], dtype=np.int8) > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    fresh[opens] = True
    start = np.flatnonzero(inside & fresh)
    if not len(start):
        return Runs(none, none, none.astype(np.uint64), none)
    seen = np.cumsum(inside, dtype=np.int32)
    count = np.diff(np.append(seen[start], seen[-1] + 1).astype(np.int64))
    return Runs(start, count, hashing.mix(least[start]),
                np.searchsorted(bounds, start, side="right") - 1)


def key_lists(runs: Runs, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of (shard, short key): shard, short key, in several documents, and the
    position of every run's key. Short keys only select candidates; equal keys stay equal."""
    shard = (runs.key % np.uint64(shards)).astype(np.uint64)
    combined = (shard << np.uint64(32)) | (runs.key >> np.uint64(32))
    distinct, inverse = np.unique(combined, return_inverse=True)
    low = np.full(len(distinct), LAST)
    high = np.full(len(distinct), -1)
    np.minimum.at(low, inverse, runs.doc)
    np.maximum.at(high, inverse, runs.doc)
    return ((distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32), low < high, inverse)


def run_bytes(data: np.ndarray, runs: Runs, inverse: np.ndarray, n: int, length: int) -> np.ndarray:
    """Bytes of the distinct runs of each of n keys, as the rounded-up fourth of a power of two."""
    sizes = runs.count + length - 1
    hashes = hashing.spans(hashing.prefix_sums(data), runs.start, runs.start + sizes)
    first = np.unique(hashes, return_index=True)[1]
    return np.ceil(4 * np.log2(np.bincount(inverse[first], sizes[first], n))).astype(np.uint8)


def single(data: np.ndarray, runs: Runs, chosen: np.ndarray, length: int) -> Runs:
    """The strings of chosen runs as runs of their own, keyed by their hashes."""
    count = runs.count[chosen]
    start = np.repeat(runs.start[chosen] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return Runs(start, np.ones(len(start), np.int64),
                hashing.spans(hashing.prefix_sums(data), start, start + length),
                np.repeat(runs.doc[chosen], count))


def answers(runs: Runs, replies: list[dict] | None, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run: its key is shared, its key is crowded."""
    shard, _, _, inverse = key_lists(runs, shards)
    counts = np.bincount(shard, minlength=shards)
    out = []
    for name in ("bits", "crowded"):
        found = [np.unpackbits(np.frombuffer(r[name], np.uint8), count=int(counts[r["shard"]])).astype(bool)
                 if r[name] else np.zeros(int(counts[r["shard"]]), bool) for r in replies or []]
        every = np.concatenate([np.zeros(0, bool), *found])
        out.append(every[inverse] if len(every) else np.zeros(len(inverse), bool))
    return out[0], out[1]


def shared_keys(blocks: DataFrame, settings: Settings, shards: int, coarse: int | None = None) -> DataFrame:
    """block, replies: per shard, bits for each of the block's keys: it occurs in several documents; it
    is crowded. `any_crowded`: one of them is. With `coarse`, the number of shards of earlier replies
    that the blocks carry, the keys are those of single strings of crowded runs, and none is crowded."""
    length = settings.length

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, bounds, _ = unpacked(row)
                runs = find_runs(data, bounds, length)
                if coarse is not None:
                    shared, crowded = answers(runs, row["replies"], coarse)
                    runs = single(data, runs, np.flatnonzero(shared & crowded), length)
                shard, short, several, inverse = key_lists(runs, shards)
                sizes = (run_bytes(data, runs, inverse, len(short), length) if coarse is None
                         else np.zeros(len(short), np.uint8))
                at = np.flatnonzero(np.diff(shard, prepend=-1))
                ends = np.append(at[1:], len(shard))
                spans = list(zip(at, ends, strict=True)) if len(shard) else []
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(shard[at], pa.int32()),
                    "block": pa.array([row["block"]] * len(spans), pa.string()),
                    "keys": pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()),
                    "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
                    "sizes": pa.array([zstandard.compress(sizes[a:b].tobytes(), 3) for a, b in spans],
                                      pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        every = np.concatenate(lists)
        several = np.concatenate([
            np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool)
            for s, k in zip(table["several"].to_pylist(), lists, strict=True)])
        sizes = np.concatenate([
            np.frombuffer(zstandard.decompress(s, max_output_size=len(k)), np.uint8)
            for s, k in zip(table["sizes"].to_pylist(), lists, strict=True)])
        distinct, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count > 1
        np.logical_or.at(shared, inverse, several)
        crowded = np.bincount(inverse, np.exp2(sizes / 4), len(distinct)) > settings.crowded_bytes
        ends = np.cumsum([len(k) for k in lists])[:-1]
        parts, crowds = np.split(shared[inverse], ends), np.split((shared & crowded)[inverse], ends)
        return pa.table({
            "block": table["block"], "shard": table["shard"],
            "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
            "crowded": pa.array([np.packbits(p).tobytes() if p.any() else None for p in crowds], pa.binary())})

    return (
        blocks.select("block", "n_bytes", "ids", "bounds", "data", *(["replies"] if coarse is not None else []))
        .mapInArrow(send, "shard int, block string, keys binary, several binary, sizes binary")
        .groupBy("shard").applyInArrow(meet, "block string, shard int, bits binary, crowded binary")
        .groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("shard", "bits", "crowded"))).alias("replies"),
            F.max(F.col("crowded").isNotNull()).alias("any_crowded"))
    )


def all_replies(blocks: DataFrame, settings: Settings, shards: int) -> DataFrame:
    """block, replies, finer: the replies to single strings of crowded keys, by `finer_shards`."""
    replies = materialise(shared_keys(blocks, settings, shards), "suffix-replies")
    crowded = replies.where("any_crowded")
    if crowded.isEmpty():
        return replies.select("block", "replies", F.lit(None).cast(replies.schema["replies"].dataType).alias("finer"))
    finer = shared_keys(blocks.join(crowded, "block"), settings, finer_shards(shards), shards)
    return replies.select("block", "replies").join(
        materialise(finer.select("block", F.col("replies").alias("finer")), "suffix-finer"), "block", "left")


def finer_shards(shards: int) -> int:
    return 4 * shards


# --- Shards of shared text -------------------------------------------------------------------------


@dataclass
class Shared:
    """A block's distinct shared substrings, in order of their shards, and where they occur: document,
    place and number of the substring, in three columns."""

    texts: list[bytes]
    shard: np.ndarray
    part: np.ndarray
    places: np.ndarray


def shared_parts(row: dict, data: np.ndarray, bounds: np.ndarray, length: int, key_shards: int,
                 text_shards: int) -> Shared:
    """The same for a block whenever it is asked for."""
    runs = find_runs(data, bounds, length)
    shared, crowded = answers(runs, row["replies"], key_shards)
    whole, split = np.flatnonzero(shared & ~crowded), np.flatnonzero(shared & crowded)
    runs, strings = Runs(runs.start[whole], runs.count[whole], runs.key[whole], runs.doc[whole]), runs
    if len(split):
        fine = single(data, strings, split, length)
        kept = answers(fine, row["finer"], finer_shards(key_shards))[0]
        runs = Runs(*(np.concatenate([a, b[kept]]) for a, b in (
            (runs.start, fine.start), (runs.count, fine.count), (runs.key, fine.key), (runs.doc, fine.doc))))
    target = (hashing.mix(runs.key) % np.uint64(text_shards * PARTS)).astype(np.int64)
    chosen = np.argsort(target, kind="stable")
    target = target[chosen]
    raw = data.tobytes()
    starts, ends = runs.start[chosen], runs.start[chosen] + runs.count[chosen] + length - 1
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(raw[a:b], len(numbers))
                      for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    shard_of = np.zeros(len(numbers), np.int64)
    shard_of[which] = target
    return Shared(list(numbers), shard_of // PARTS, shard_of % PARTS, np.column_stack([runs.doc[chosen], starts, which]))


def shared_texts(blocks: DataFrame, replies: DataFrame, settings: Settings, key_shards: int,
                 text_shards: int) -> DataFrame:
    """block, shard, first (number of the first substring), n, and the substrings sent there: their
    sizes, least and largest ids, and bytes, compressed."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, bounds, ids = unpacked(row)
                found = shared_parts(row, data, bounds, settings.length, key_shards, text_shards)
                n = len(found.texts)
                least, most = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
                np.minimum.at(least, found.places[:, 2], ids[found.places[:, 0]])
                np.maximum.at(most, found.places[:, 2], ids[found.places[:, 0]])
                at = np.flatnonzero(np.diff(found.shard, prepend=-1))
                spans = list(zip(at.tolist(), [*at[1:].tolist(), n], strict=True)) if n else []
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * len(spans), pa.string()),
                    "shard": pa.array(found.shard[at] if n else [], pa.int32()),
                    "first": pa.array([a for a, _ in spans], pa.int32()),
                    "n": pa.array([b - a for a, b in spans], pa.int32()),
                    "facts": pa.array([zstandard.compress(b"".join((
                        np.array([len(t) for t in found.texts[a:b]], np.int32).tobytes(),
                        least[a:b].tobytes(), (most[a:b] - least[a:b]).tobytes(),
                        found.part[a:b].astype(np.uint8).tobytes())), 3)
                        for a, b in spans], pa.binary()),
                    "data": pa.array([zstandard.compress(b"".join(found.texts[a:b]), 3)
                                      for a, b in spans], pa.binary())})

    return blocks.select("block", "n_bytes", "ids", "bounds", "data").join(replies, "block").mapInArrow(
        cut, "block string, shard int, first int, n int, facts binary, data binary")


def lone(texts: list[bytes], length: int) -> np.ndarray:
    """Which of a shard's distinct texts share no string of `length` with another one: those whose key no
    other has, and those whose key only texts of one string have, as these differ."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = hashing.grams(hashing.prefix_sums(np.frombuffer(b"".join(texts), np.uint8)), GRAM)
    key = hashes[starts]
    for step in range(1, length - GRAM + 1):
        np.minimum(key, hashes[starts + step], out=key)
    distinct, which, count = np.unique(key, return_inverse=True, return_counts=True)
    longest = np.zeros(len(distinct), np.int64)
    np.maximum.at(longest, which, sizes)
    return ((count == 1) | (longest == length))[which]


def least_ids(texts: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` in distinct texts, as stretches with one least id of a text that has
    them: rows of (text, offset, count, id) in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    s = np.append(np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + 2, 0)
    s[ends - 1] = 1  # between texts
    s = s.astype(np.int32)
    owner = np.append(np.repeat(np.arange(len(texts)), sizes + 1), 0)
    whole = np.append(np.arange(len(s) - 1) + length < ends[owner[:-1]], False)
    order = induced.suffix_array(s)
    equal = induced.common_prefixes(s, order) >= length
    order = order[whole[order]]
    least = np.full(len(s), LAST)
    if len(order):
        first = ~equal[order]
        first[0] = True
        lowest = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(first))
        least[order] = lowest[np.cumsum(first) - 1]
    places = np.flatnonzero(whole)
    text, low = owner[places], least[places]
    new = np.ones(len(places), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(places)))
    return np.column_stack([text[at], places[at] - starts[text[at]], count, low[at]])


def repeats(cut: DataFrame, settings: Settings) -> DataFrame:
    """block, hits: (number, offset, count, least id) of strings that a smaller id has as well."""

    def match(table: pa.Table) -> pa.Table:
        numbered: dict[bytes, int] = {}
        which, least, most, parts = [], [], [], []
        for facts, packed, n in zip(table["facts"], table["data"], table["n"].to_pylist(), strict=True):
            facts = zstandard.decompress(facts.as_py(), max_output_size=21 * n)
            sizes = np.frombuffer(facts, np.int32, n).tolist()
            low = np.frombuffer(facts, np.int64, n, 4 * n)
            data = zstandard.decompress(packed.as_py(), max_output_size=sum(sizes) + 1)
            at, own = 0, []
            for size in sizes:
                own.append(numbered.setdefault(data[at:at + size], len(numbered)))
                at += size
            which.append(np.array(own, np.int64))
            least.append(low)
            most.append(low + np.frombuffer(facts, np.int64, n, 12 * n))
            parts.append(np.frombuffer(facts, np.uint8, n, 20 * n))
        ids = np.full(len(numbered), LAST)
        for own, low in zip(which, least, strict=True):
            np.minimum.at(ids, own, low)
        part_of = np.zeros(len(numbered), np.int64)
        for own, part in zip(which, parts, strict=True):
            part_of[own] = part
        texts = list(numbered)
        alone = lone(texts, settings.length)
        part_of[alone] = PARTS
        in_order = np.argsort(part_of, kind="stable")
        bounds = np.searchsorted(part_of[in_order], np.arange(PARTS + 2))
        found = []
        for a, b in zip(bounds[:-1], bounds[1:-1], strict=False):
            if b > a:
                listed = least_ids([texts[i] for i in in_order[a:b]], ids[in_order[a:b]], settings.length)
                listed[:, 0] += a
                found.append(listed)
        rest = in_order[bounds[PARTS]:]
        found.append(np.column_stack([
            np.arange(bounds[PARTS], len(texts)), np.zeros(len(rest), np.int64),
            np.array([len(texts[i]) for i in rest], np.int64) - settings.length + 1, ids[rest]]))
        stretches = np.concatenate(found)
        first_row = np.searchsorted(stretches[:, 0], np.arange(len(texts) + 1))
        rank = np.empty(len(texts), np.int64)
        rank[in_order] = np.arange(len(texts))
        blocks, hits = [], []
        for block, start, own, top in zip(table["block"].to_pylist(), table["first"].to_pylist(), which,
                                          most, strict=True):
            own = rank[own]
            n = first_row[own + 1] - first_row[own]
            entry = np.repeat(np.arange(len(own)), n)
            row = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + first_row[own[entry]]
            below = stretches[row, 3] < top[entry]
            if below.any():
                listed = stretches[row[below]]
                listed[:, 0] = entry[below] + start
                blocks.append(block)
                hits.append(listed.tobytes())
        release()
        return pa.table({"block": pa.array(blocks, pa.string()), "hits": pa.array(hits, pa.binary())})

    return cut.groupBy("shard").applyInArrow(match, "block string, hits binary")


# --- Result ------------------------------------------------------------------------------------------


def _removed(row: dict, data: np.ndarray, ids: np.ndarray, seen: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a block go."""
    change = np.zeros(len(data) + 1, np.int64)
    if row["hits"]:
        hits = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 4) for h in row["hits"]])
        seen = seen[np.argsort(seen[:, 2], kind="stable")]
        first = np.searchsorted(seen[:, 2], hits[:, 0])
        count = np.searchsorted(seen[:, 2], hits[:, 0], side="right") - first
        hit = np.repeat(np.arange(len(hits)), count)
        at = np.repeat(first, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        over = ids[seen[at, 0]] > hits[hit, 3]
        hit, at = hit[over], at[over]
        begin = seen[at, 1] + hits[hit, 1]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + hits[hit, 2] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, carry: Sequence[str] = (), settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and the carried columns in the
    struct `rest`."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        *([F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []))
    rest = rows.schema["rest"].dataType if carry else None
    blocks = materialise(packed(rows, settings, rest), "suffix-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    key_shards = 8 + total // settings.key_shard_bytes
    replies = all_replies(blocks, settings, key_shards)
    # Shared strings can be all of the text, several times over; distinct ones mostly are not.
    text_shards = 8 + total // (4 * settings.text_shard_bytes)
    cut = shared_texts(blocks, replies, settings, key_shards, text_shards)
    hits = repeats(cut, settings).groupBy("block").agg(F.collect_list("hits").alias("hits"))
    out = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    if rest is not None:
        out = out.add("rest", rest)

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.drop_columns(["rest"] if rest is not None else []).to_pylist()):
                data, bounds, ids = unpacked(row)
                # Where the substrings occur is found again rather than kept.
                seen = shared_parts(row, data, bounds, settings.length, key_shards, text_shards
                                    ).places if row["hits"] else None
                gone = _removed(row, data, ids, seen, settings.length)
                before = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[bounds[:-1][bounds[:-1] < len(gone)]] = gone[bounds[:-1][bounds[:-1] < len(gone)]]
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = data[~gone].tobytes()
                ends = (bounds - before[bounds]).tolist()
                columns = {
                    "doc_id": pa.array(row["ids"], pa.int64()),
                    "n_bytes": np.diff(bounds), "n_removed": np.diff(before[bounds]),
                    "n_spans": np.diff(spans[bounds]),
                    "kept": pa.array([kept[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())}
                if rest is not None:
                    columns["rest"] = batch["rest"].slice(at, 1).flatten()
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.join(replies, "block", "left").join(hits, "block", "left").mapInArrow(finish, out)


def shortened(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with their remaining texts, with all columns. Bytes of characters that were cut
    apart are left out; n_chars, if there, is counted anew. Rows stay, also with an empty text."""
    columns = list(docs.columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", "ignore") for k in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch["rest"]],
                                             names=["text", "rest"])

    carried = tuple(c for c in columns if c != "text")
    found = deduplicated(docs, carried, settings).select("kept", "rest")
    out = found.mapInArrow(decode, StructType().add("text", "string").add(found.schema["rest"]))
    values = {"text": F.col("text")}
    if "n_chars" in columns:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values.get(c, F.col("rest").getField(c)).alias(c) for c in columns])
