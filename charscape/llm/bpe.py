"""Byte-level BPE encoding and decoding, with tree concatenation of long texts.

Short texts are encoded where they are read. A longer one is cut into pieces of `piece_chars`; all
pieces of all texts are encoded in parallel, and the pieces of a text are joined pairwise, halves by
halves. A join re-encodes a window around the cut and widens it until both sides agree:

* Usually the window starts at a word boundary of the left side that the cut cannot have changed, and
  ends at the first boundary behind the cut that the window and the right side share. From a shared
  boundary on, both split the text alike, as the splitting pattern never looks back.
* If one long run without boundaries crosses the cut, the window is a number of tokens of the run to
  either side, encoded without splitting. It fits if its outer tokens are those of the two sides: in a
  BPE encoding every pair of neighbours is stable by itself, so a shared token joins two encodings.

The result is the one that encoding the text in one piece would give, token by token.

Texts of Latin characters are encoded by a faster library with the same vocabulary and pattern. All
others, and texts with special tokens, go through the tokenizer itself, since the two libraries' tables
of letters and digits may differ in age.

Defined cases: NULL texts are encoded as empty ones, without tokens; rows that repeat give equal rows;
special tokens spelled out in a text become those tokens, also across cuts; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charscape.llm.common import small_batches, tidy

PIECE_CHARS = 16_384
# Fixed pattern by which byte-level BPE splits texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAR = re.compile("[^\x00-\u024f]")
WORDS = regex.compile(PATTERN)
BATCH = 128
MARGIN = 16  # characters: longer than a special token and than any look-ahead of the pattern


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token. A vocabulary spells byte b as character b where that is printable,
    and the other bytes, in order, as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    special = {i: t.encode() for t, i in special_tokens(path).items()}
    out = [b""] * (1 + max([*vocabulary.values(), *special]))
    for token, number in vocabulary.items():
        if number not in special:
            out[number] = bytes(spelled[c] for c in token)
    for number, text in special.items():
        out[number] = text
    return out


@functools.lru_cache(maxsize=4)
def fast_encoder(path: str) -> tiktoken.Encoding:
    """The same vocabulary, in which a merge's rank is its token's number."""
    special = set(special_tokens(path).values())
    ranks = {t: i for i, t in enumerate(token_bytes(path)) if t and i not in special}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_sizes(path: str) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(path)], np.int64)


def is_plain(path: str, text: str) -> bool:
    """Whether the faster library may encode a text."""
    return (text.isascii() or not FAR.search(text)) and not any(t in text for t in special_tokens(path))


def encode_text(path: str, text: str) -> np.ndarray:
    if is_plain(path, text):
        return fast_encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.int32)


@dataclass
class Piece:
    """The encoding of text[start:end] by itself. bounds: starts of words; first: their first token."""

    start: int
    end: int
    ids: np.ndarray
    bounds: np.ndarray
    first: np.ndarray

    def token_at(self, bound: int) -> int:
        """Index of the first token of the word that starts at a boundary."""
        at = int(np.searchsorted(self.bounds, bound))
        return int(self.first[at]) if at < len(self.bounds) else len(self.ids)


def encode_piece(path: str, text: str, start: int = 0) -> Piece:
    if is_plain(path, text):
        ids = encode_text(path, text)
        bounds = np.array([m.start() for m in WORDS.finditer(text)], np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        bytes_of_chars = np.flatnonzero((data & 0xC0) != 0x80)
        sizes = token_sizes(path)[ids]
        first = np.searchsorted(np.cumsum(sizes) - sizes, bytes_of_chars[bounds])
        return Piece(start, start + len(text), ids, bounds + start, first)
    found = tokenizer(path).encode(text, add_special_tokens=False)
    words = np.array(found.word_ids, np.int64)
    first = np.flatnonzero(np.diff(words, prepend=-1) != 0) if len(words) else np.zeros(0, np.int64)
    offsets = np.array([o[0] for o in found.offsets], np.int64)
    return Piece(start, start + len(text), np.array(found.ids, np.int32),
                 offsets[first] + start if len(first) else first, first)


def _spelled(piece: Piece) -> bytes:
    """A piece in few bytes, without its place."""
    parts = (np.array([len(piece.ids), len(piece.bounds)]), piece.ids,
             np.diff(piece.bounds, prepend=piece.start), np.diff(piece.first, prepend=0))
    return zstandard.compress(np.concatenate(parts).astype(np.int32).tobytes(), 3)


def _read(coded: bytes, start: int, size: int) -> Piece:
    data = np.frombuffer(zstandard.decompress(coded), np.int32)
    n, words = int(data[0]), int(data[1])
    rest = data[2 + n:].astype(np.int64)
    return Piece(start, start + size, data[2:2 + n], start + np.cumsum(rest[:words]),
                 np.cumsum(rest[words:]))


def join(path: str, text: str, a: Piece, b: Piece, window: int = 64) -> Piece:
    """The encoding of both pieces' text. `text` is whole; pieces hold places in it."""
    if not len(a.ids) or not len(b.ids):
        return Piece(a.start, b.end, np.concatenate([a.ids, b.ids]),
                     np.concatenate([a.bounds, b.bounds]),
                     np.concatenate([a.first, b.first + len(a.ids)]))
    run = _join_run(path, text, a, b) if _crosses(a, b, window) else None
    if run is not None:
        return run
    cut = a.end
    sure = int(np.searchsorted(a.bounds, cut - MARGIN, side="right")) - 1
    x = int(a.bounds[sure]) if sure >= 0 else a.start
    x_token = a.token_at(x) if sure >= 0 else 0
    while True:
        end = min(b.end, cut + window)
        middle = encode_piece(path, text[x:end], x)
        known = middle.bounds if end == b.end else middle.bounds[middle.bounds <= end - MARGIN]
        shared = np.intersect1d(known[known >= cut], b.bounds)
        if len(shared) or end == b.end:
            y = int(shared[0]) if len(shared) else b.end
            return _concat(a, x_token, middle, 0, middle.token_at(y), b, b.token_at(y), x, y)
        window *= 2


def _concat(a: Piece, a_stop: int, m: Piece, m_start: int, m_stop: int, b: Piece, b_start: int,
            x: int, y: int) -> Piece:
    keep_a, keep_m, keep_b = a.bounds < x, (m.bounds >= x) & (m.bounds < y), b.bounds >= y
    return Piece(
        a.start, b.end,
        np.concatenate([a.ids[:a_stop], m.ids[m_start:m_stop], b.ids[b_start:]]),
        np.concatenate([a.bounds[keep_a], m.bounds[keep_m], b.bounds[keep_b]]),
        np.concatenate([a.first[keep_a], m.first[keep_m] - m_start + a_stop,
                        b.first[keep_b] - b_start + a_stop + m_stop - m_start]))


def _crosses(a: Piece, b: Piece, window: int) -> bool:
    """Whether the words at the cut are too long to be worth encoding anew."""
    next_bound = int(b.bounds[1]) if len(b.bounds) > 1 else b.end
    return a.end - int(a.bounds[-1]) > 4 * window and next_bound - b.start > 4 * window


def _join_run(path: str, text: str, a: Piece, b: Piece) -> Piece | None:
    """Join inside one word that crosses the cut; None if it is not one word."""
    model = tokenizer(path)
    start = int(a.bounds[-1])
    stop = int(b.bounds[1]) if len(b.bounds) > 1 else b.end
    around = text[max(a.start, start - MARGIN):min(b.end, stop + MARGIN)]
    if any(t in around for t in special_tokens(path)):
        return None
    ahead = text[start:min(b.end, stop + MARGIN)]
    if model.pre_tokenizer.pre_tokenize_str(ahead)[0][1] != (0, stop - start):
        return None
    left, right = a.ids[a.token_at(start):], b.ids[:b.token_at(stop)]
    reach = 8
    while True:
        l_part, r_part = left[-reach:], right[:reach]
        spelled = "".join(model.id_to_token(int(i)) for i in (*l_part, *r_part))
        middle = np.array([t.id for t in model.model.tokenize(spelled)], np.int32)
        fits_left = len(l_part) == len(left) or np.array_equal(middle[:2], l_part[:2])
        fits_right = len(r_part) == len(right) or np.array_equal(middle[-2:], r_part[-2:])
        if fits_left and fits_right and len(middle) >= 4 or reach >= max(len(left), len(right)):
            break
        reach *= 2
    a_stop, b_start = len(a.ids) - len(l_part), len(r_part)
    keep_b = b.bounds >= stop
    return Piece(
        a.start, b.end, np.concatenate([a.ids[:a_stop], middle, b.ids[b_start:]]),
        np.concatenate([a.bounds, b.bounds[keep_b]]),
        np.concatenate([a.first, b.first[keep_b] - b_start + a_stop + len(middle)]))


def join_all(path: str, text: str, pieces: list[Piece]) -> np.ndarray:
    """Joins neighbours, level by level, until one encoding is left."""
    while len(pieces) > 1:
        pieces = [join(path, text, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i]
                  for i in range(0, len(pieces), 2)]
    return pieces[0].ids


ENCODED = "doc_id long, ids array<int>"


def encoded(docs: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids of every document."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > piece_chars

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]), pa.int32()))

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = [encode_text(path, t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "ids": listed(found)})

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                coded = [_spelled(encode_piece(path, t)) for t in part["piece"].to_pylist()]
                yield part.append_column("coded", pa.array(coded, pa.binary()))

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                parts = {p["no"]: p for p in row["pieces"]}
                copies = len(row["pieces"]) // len(parts)
                in_order = [parts[no] for no in sorted(parts)]
                text = "".join(p["piece"] for p in in_order)
                pieces, start = [], 0
                for p in in_order:
                    pieces.append(_read(p["coded"], start, len(p["piece"])))
                    start += len(p["piece"])
                ids = join_all(path, text, pieces)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([row["doc_id"]] * copies, pa.int64()),
                    "ids": listed([ids] * copies)})

    starts = F.sequence(F.lit(0), F.col("n_pieces") - 1)
    pieces = (
        rows.where(long)
        .withColumns({"n_pieces": F.ceil(F.length("text") / piece_chars).cast("int"),
                      "digest": F.sha2("text", 256)})
        .select("doc_id", "digest", "text", F.explode(starts).alias("no"))
        .select("doc_id", "digest", "no",
                F.expr(f"substring(text, no * {piece_chars} + 1, {piece_chars})").alias("piece"))
    )
    # A text's pieces meet in one row, as the text itself did.
    long_rows = (
        pieces.repartition("digest", "no").mapInArrow(
            cut, "doc_id long, digest string, no int, piece string, coded binary")
        .groupBy("doc_id", "digest")
        .agg(F.collect_list(F.struct("no", "piece", "coded")).alias("pieces"))
        .select("doc_id", "pieces").mapInArrow(joined, ENCODED)
    )
    return rows.where(~long).mapInArrow(whole, ENCODED).unionByName(long_rows)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text, special tokens included; broken bytes become U+FFFD."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = part["ids"]
                flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
                ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
                texts = [b"".join([table[i] for i in flat[a:b]]).decode("utf-8", "replace")
                         for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "ids": ids, "text": pa.array(texts, pa.string())})

    return small_batches(tokens).select("doc_id", "ids").mapInArrow(run, f"{ENCODED}, text string")
