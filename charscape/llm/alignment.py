"""Alignment of two tokenizers over the same texts, as an Arrow pipeline inside Spark tasks.

Tokenizer A is a byte-level BPE that reads a space and the text; tokenizer B is a piece model that adds the
space itself. Where tokens of both end at the same byte, the text is cut into groups, and all tokens of a
group are linked.

1. Texts are gathered into blocks of about `block_bytes` and encoded. Token lists are flattened, with the
   index of their text (`list_parent_indices`); a cumulative sum of token sizes, less the sum before the
   text, is each token's end. Ends of A and B meet in a hash join on (text, end); the number of common ends
   before a token is its group.
2. A second hash join on the group gives the linked pairs of ids; where a group has many tokens, its ids
   are counted first. `group_by` counts a pair's links in each document, and the documents of the block
   that hold it.
3. A block is written as one row: figures per document, and its pairs with the documents that hold them.
   Spark adds the counts of all blocks by pair and takes the highest per A id.
4. The counts go back to the blocks by pair, once per block and pair, where they meet the links of each
   document. A pair in every document costs one row per block.

Long texts are cut into chunks where both tokenizers end a token for certain: before a single space, or
before a single line break, between other characters. No piece of B holds a space behind another
character or a line break (checked when it is loaded), and A's splitting pattern never joins the two
sides. A text without such places is one chunk.

Defined cases: texts that are NULL or empty, or whose tokens do not spell them (say, texts that hold the
character by which B spells a space), have no tokens and zeros everywhere; rows that repeat are documents of
their own; an empty table gives an empty result. Special tokens spelled out in texts are plain text.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.llm import bpe
from charscape.llm.common import materialise, small_batches, tidy

SPACE_PIECE = "▁"
CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
MANY = 64  # tokens of one side of a group from which its ids are counted before they are joined
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 8 << 20
    slice_bytes: int = 1 << 20
    chunk_chars: int = 1 << 16


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The piece model, the bytes of its tokens, and whether texts may be cut for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled, sound = [], True
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled.append(bytes([int(piece[3:-1], 16)]))
        else:
            sound &= not re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}|\n", piece)
            spelled.append(piece.replace(SPACE_PIECE, " ").encode())
    return model, pa.array(spelled, pa.binary()), sound


@functools.lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    """The byte-level tokenizer with special tokens' strings as plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = True
    return out


@functools.lru_cache(maxsize=2)
def spellings(path: str) -> pa.Array:
    return pa.array(bpe.token_bytes(path), pa.binary())


@functools.lru_cache(maxsize=4)
def decimals(count: int) -> pa.Array:
    return pa.array([str(i) for i in range(count)])


def encode_a(path: str, text: str) -> np.ndarray:
    if text.isascii() or not bpe.FAR.search(text):
        return bpe.fast_encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return np.array(plain_tokenizer(path).encode(text, add_special_tokens=False).ids, np.int32)


def chunks(text: str, size: int, sound: bool) -> list[str]:
    """Parts of a text, each but the first starting at a certain cut."""
    out, start = [], 0
    while sound and len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]


def encode_b(path: str, parts: list[str], first: list[bool]) -> list[list[int]]:
    """Ids of chunks. The model adds a space in front: it stands for a chunk's own, or is taken away."""
    model, _, _ = pieces(path)
    given = [p[1:] if not f and p[0] == " " else p for p, f in zip(parts, first, strict=True)]
    ids = model.encode(given, num_threads=1)
    return [i[1:] if not f and p[0] == "\n" else i for i, p, f in zip(ids, parts, first, strict=True)]


def flat_lists(lists: list) -> tuple[pa.Array, pa.Array]:
    """Values and parents of token lists."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    nested = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
    return pc.list_flatten(nested), pc.cast(pc.list_parent_indices(nested), pa.int32())


def segmented_ends(sizes: pa.Array, parents: pa.Array) -> pa.Array:
    """Sums of sizes up to and with every value, begun anew for each parent."""
    sums = pc.cumulative_sum(sizes)
    if not len(sums):
        return sums
    at = parents.to_numpy()
    first = np.flatnonzero(np.diff(at, prepend=-1))
    before = sums.to_numpy()[first] - sizes.to_numpy()[first]
    lengths = np.diff(np.append(first, len(at)))
    return pc.subtract(sums, pa.array(np.repeat(before, lengths)))


def joined_lists(values: pa.Array, starts: np.ndarray, total: int, separator: str) -> pa.Array:
    """Strings joined within the lists that begin at `starts`."""
    offsets = pa.array(np.append(starts, total).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), separator)


def spells(text: pa.Array, tokens: pa.Array, parents: pa.Array, count: int) -> np.ndarray:
    """Whether the tokens' bytes, joined by parent, are the texts."""
    sizes = pc.binary_length(tokens).to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(parents.to_numpy(), sizes, count)).astype(np.int64)])
    want = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))])
    one, two = _joined(tokens), _joined(text)
    if np.array_equal(at, want) and one == two:
        return np.ones(count, bool)
    return np.array([one[at[i]:at[i + 1]] == two[want[i]:want[i + 1]] for i in range(count)], bool)


def _joined(values: pa.Array) -> memoryview:
    if not len(values) or values.buffers()[2] is None:
        return memoryview(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return memoryview(values.buffers()[2])[int(offsets[0]):int(offsets[-1])]


def linked_pairs(group: dict[str, np.ndarray], ids: dict[str, np.ndarray], width: int) -> pa.Table:
    """Pairs (as a * width + b), their group and number of links, of all groups."""
    count = int(group["a"][-1]) + 1 if len(group["a"]) else 0
    sizes = {side: np.bincount(group[side], minlength=count) for side in "ab"}
    many = (sizes["a"] >= MANY) | (sizes["b"] >= MANY)
    # Most groups are one token of each side: a pair as it stands.
    alone = (sizes["a"] == 1) & (sizes["b"] == 1)
    one = {side: ids[side][alone[group[side]]].astype(np.int64) for side in "ab"}
    singles = pa.table({"group": np.flatnonzero(alone), "pair": one["a"] * width + one["b"],
                        "links": np.ones(int(alone.sum()), np.int64)})
    rest = {side: ~alone[group[side]] for side in "ab"}
    group = {side: group[side][rest[side]] for side in "ab"}
    ids = {side: ids[side][rest[side]] for side in "ab"}

    def counted(side: str) -> pa.Table:
        full = many[group[side]]
        table = pa.table({"group": group[side], side: ids[side]})
        few = table.filter(pa.array(~full)).append_column(
            f"n_{side}", pa.array(np.ones(int((~full).sum()), np.int64)))
        if not full.any():
            return few
        sums = table.filter(pa.array(full)).group_by(["group", side], use_threads=False).aggregate([([], "count_all")])
        return pa.concat_tables([few, sums.rename_columns(["group", side, f"n_{side}"])])

    met = counted("a").join(counted("b"), "group", join_type="inner", use_threads=False)
    pair = pc.add(pc.multiply(pc.cast(met["a"], pa.int64()), width), pc.cast(met["b"], pa.int64()))
    met = pa.table({"group": met["group"], "pair": pair, "links": pc.multiply(met["n_a"], met["n_b"])})
    return pa.concat_tables([singles, met])


def align(parts: list[str], first: list[bool], path_a: str, path_b: str) -> tuple[np.ndarray, ...]:
    """Figures, spelled groups and linked pairs of chunks.

    Returns soundness and four counts by chunk, the spelled groups by chunk, and a table (chunk, pair, links).
    """
    n = len(parts)
    bytes_a, (_, bytes_b, _) = spellings(path_a), pieces(path_b)
    texts = [f" {p}" if f else p for p, f in zip(parts, first, strict=True)]
    whole = pa.array(texts, pa.string()).cast(pa.binary())
    lists = {"a": [encode_a(path_a, t) for t in texts], "b": encode_b(path_b, parts, first)}
    ok = np.ones(n, bool)
    flat_of, sizes_of = {}, {}
    for side, table in (("a", bytes_a), ("b", bytes_b)):
        flat, parents = flat_of[side] = flat_lists(lists[side])
        tokens = table.take(flat)
        sizes_of[side] = pc.cast(pc.binary_length(tokens), pa.int64())
        ok &= spells(whole, tokens, parents, n)
    ids, group, flags, starts, keyed = {}, {}, {}, {}, {}
    for side in "ab":
        flat, parents = flat_of[side]
        sizes = sizes_of[side]
        if not ok.all():
            kept = pa.array(ok).take(parents)
            flat, parents, sizes = flat.filter(kept), parents.filter(kept), sizes.filter(kept)
        ids[side] = flat
        starts[side] = parents.to_numpy()
        keyed[side] = pa.table({"chunk": parents, "end": segmented_ends(sizes, parents),
                                f"at_{side}": pa.array(np.arange(len(flat), dtype=np.int64))})
    common = keyed["a"].join(keyed["b"], ["chunk", "end"], join_type="inner", use_threads=False)
    heads = {}
    for side in "ab":
        flags[side] = np.zeros(len(ids[side]), np.int64)
        flags[side][common[f"at_{side}"].to_numpy()] = 1
        group[side] = np.cumsum(flags[side]) - flags[side]
        heads[side] = np.flatnonzero(np.diff(group[side], prepend=-1))
    groups = len(heads["a"])
    chunk_of = starts["a"][heads["a"]] if groups else np.zeros(0, np.int32)
    counts = np.stack([
        np.bincount(starts["a"], minlength=n), np.bincount(starts["b"], minlength=n),
        np.bincount(chunk_of, minlength=n)]).astype(np.int64)
    lines = [joined_lists(decimals(len(t)).take(ids[s]), heads[s], len(ids[s]), ",")
             for s, t in (("a", bytes_a), ("b", bytes_b))]
    both = pc.binary_join_element_wise(*lines, "|")
    bounds = np.concatenate([[0], np.cumsum(counts[2])])
    spelled = joined_lists(both, bounds[:-1], groups, ";")
    found = linked_pairs(group, {s: ids[s].to_numpy() for s in "ab"}, len(bytes_b))
    chunk = pa.array(chunk_of).take(found["group"].combine_chunks()) if groups else pa.array([], pa.int32())
    return ok, counts, spelled, pa.table({"chunk": chunk, "pair": found["pair"], "links": found["links"]})


class Block:
    """Documents gathered by a task, and their links so far."""

    def __init__(self, path_a: str, path_b: str, settings: Settings):
        self.paths, self.settings = (path_a, path_b), settings
        self.sound = pieces(path_b)[2]
        self.ids: list = []
        self.size = 0
        self.parts: list[str] = []
        self.first: list[bool] = []
        self.owner: list[int] = []
        self.waiting = 0
        self.figures: list[tuple[np.ndarray, np.ndarray]] = []
        self.bad: set[int] = set()
        self.hashes: dict[int, "hashlib._Hash"] = {}
        self.tables: list[pa.Table] = []

    def add(self, number, text: str | None) -> None:
        document = len(self.ids)
        self.ids.append(number)
        if not text:
            return
        self.size += len(text)
        for i, part in enumerate(chunks(text, self.settings.chunk_chars, self.sound)):
            self.parts.append(part)
            self.first.append(i == 0)
            self.owner.append(document)
            self.waiting += len(part)
            if self.waiting >= self.settings.slice_bytes:
                self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        owner = np.array(self.owner, np.int64)
        ok, counts, spelled, table = align(self.parts, self.first, *self.paths)
        self.bad |= set(owner[~ok].tolist())
        self.figures.append((owner, counts))
        for document, text in zip(self.owner, spelled.to_pylist(), strict=True):
            own = self.hashes.get(document)
            if own is None:
                own = self.hashes[document] = hashlib.sha256()
            else:
                own.update(b";")
            own.update((text or "").encode())
        table = table.set_column(0, "document", pa.array(owner[table["chunk"].to_numpy()]))
        self.tables.append(table.group_by(["document", "pair"], use_threads=False).aggregate([("links", "sum")]))
        self.parts, self.first, self.owner, self.waiting = [], [], [], 0

    def row(self, number: int) -> pa.RecordBatch:
        """The block as one row."""
        self.flush()
        n = len(self.ids)
        counts = np.zeros((4, n), np.int64)
        for owner, part in self.figures:
            for k in range(3):
                np.add.at(counts[k], owner, part[k])
        bad = np.zeros(n, bool)
        bad[list(self.bad)] = True
        if self.tables:
            links = pa.concat_tables(self.tables).group_by(["document", "pair"], use_threads=False).aggregate(
                [("links_sum", "sum")])
            document, pair, times = (links[c].to_numpy() for c in ("document", "pair", "links_sum_sum"))
            good = ~bad[document]
            document, pair, times = document[good], pair[good], times[good]
        else:
            document = pair = times = np.zeros(0, np.int64)
        counts[:, bad] = 0
        np.add.at(counts[3], document, times)
        order = np.lexsort((pair, document))
        document, pair, times = document[order], pair[order], times[order]
        distinct, places = np.unique(pair, return_inverse=True)
        held = np.bincount(places, minlength=len(distinct))
        digests = ["" if bad[i] or i not in self.hashes else self.hashes[i].hexdigest() for i in range(n)]
        sizes = np.bincount(document, minlength=n)

        def one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        return pa.RecordBatch.from_pydict({
            "block": pa.array([number], pa.int64()), "ids": one(self.ids, pa.int64()),
            **{name: one(counts[k], pa.int64()) for k, name in enumerate(FIGURES)},
            "digests": one(digests, pa.string()),
            "pairs": one(distinct, pa.int64()), "held": one(held.astype(np.int32), pa.int32()),
            "sizes": one(sizes.astype(np.int32), pa.int32()),
            "places": pa.array([packed(places)], pa.binary()), "times": pa.array([packed(times)], pa.binary())})


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.asarray(values, np.int32).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int32)


BLOCK = ("block long, ids array<long>, " + ", ".join(f"{n} array<long>" for n in FIGURES)
         + ", digests array<string>, pairs array<long>, held array<int>, sizes array<int>, places binary, "
           "times binary")
LONGS = ("doc_id", *FIGURES, "n_best", "count_sum")
RESULT = ", ".join(f"{n} long" for n in LONGS) + ", groups_sha256 string"
RESULT_SCHEMA = pa.schema([*[(n, pa.int64()) for n in LONGS], ("groups_sha256", pa.string())])


def blocks(docs: DataFrame, path_a: str, path_b: str, settings: Settings) -> DataFrame:
    """Documents encoded, grouped and linked, block by block."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        block = Block(path_a, path_b, settings)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                block.add(doc_id, text.as_py())
                if block.size >= settings.block_bytes:
                    yield block.row(number)
                    number += 1
                    block = Block(path_a, path_b, settings)
        if block.ids:
            yield block.row(number)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def pair_counts(stored: DataFrame, width: int) -> DataFrame:
    """pair, count (documents that hold it), best (whether no pair of its A id has more)."""
    counts = (
        stored.select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count"))
    )
    counts = materialise(counts, "align-counts")
    a = F.floor(F.col("pair") / F.lit(width).cast("double")).cast("int")
    # A row per id of tokenizer A.
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def rated(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents, with the corpus-wide counts of its pairs."""
    row = left.to_pylist()[0]
    n = len(row["ids"])
    document = np.repeat(np.arange(n), row["sizes"])
    links = pa.table({"document": document,
                      "pair": pa.array(row["pairs"], pa.int64()).take(pa.array(unpacked(row["places"]))),
                      "times": pa.array(unpacked(row["times"]), pa.int64())})
    met = links.join(right.select(["pair", "count", "best"]), "pair", join_type="inner", use_threads=False)
    document = met["document"].to_numpy()
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(best, document, pc.multiply(met["times"], pc.cast(met["best"], pa.int64())).to_numpy())
    np.add.at(total, document, pc.multiply(met["times"], met["count"]).to_numpy())
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), **{f: row[f] for f in FIGURES},
                     "n_best": best, "count_sum": total, "groups_sha256": pa.array(row["digests"], pa.string())},
                    schema=RESULT_SCHEMA)


def aligned(docs: DataFrame, path_a: str, path_b: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    width = pieces(path_b)[0].get_piece_size()
    stored = materialise(blocks(docs, path_a, path_b, settings), "align-blocks")
    pairs = stored.select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair")).join(
        pair_counts(stored, width), "pair")
    # A block whose documents have no tokens has no pairs: cogrouping keeps it.
    return stored.groupBy("block").cogroup(pairs.groupBy("of_block")).applyInArrow(rated, RESULT)
