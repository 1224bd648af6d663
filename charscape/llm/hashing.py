"""Array hashing of text bytes, shared by the near-duplicate and the substring operators."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def byte_values(fold_case: bool) -> np.ndarray:
    """A random 64-bit value per byte; A-Z as a-z if case is folded."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold_case:
        values = values.copy()
        values[65:91] = values[97:123]
    return values


@functools.lru_cache(maxsize=4)
def powers(count: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i modulo 2 ** 64 for i below count, or the powers of its inverse."""
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    out = np.empty(count, np.uint64)
    out[0] = 1
    done = 1
    while done < count:  # doubling
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, count - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


def _room(size: int) -> int:
    return 1 << max(10, int(size).bit_length())


def prefix_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Sums over i < n of value(data[i]) * BASE ** i, for n from 0 to len(data)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(fold_case)[data] * powers(_room(len(data)))[:len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between starts and ends, independent of their place."""
    return mix((sums[ends] - sums[starts]) * powers(_room(len(sums)), True)[starts])


def grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of a size."""
    differences = sums[size:] - sums[:-size]
    differences *= powers(_room(len(sums) - 1), True)[:len(differences)]
    return mix(differences)


def least_grams(sums: np.ndarray, size: int, count: int, chunk: int = 1 << 14) -> np.ndarray:
    """The least of the hashes of each `count` successive strings of a size, in chunks that stay in the
    processor's caches."""
    n = len(sums) - size - count + 1
    unshift = powers(_room(len(sums) - 1), True)
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, chunk):
        end = min(n, at + chunk) + count - 1
        least = mix((sums[at + size:end + size] - sums[at:end]) * unshift[at:end])
        width = 1
        while 2 * width <= count:  # least of the next `width` hashes, by doubling
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < count:
            least = np.minimum(least[:len(least) - (count - width)], least[count - width:])
        out[at:at + len(least)] = least
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the bounds of its rows; NULL is empty."""
    kind = pa.large_binary()
    flat = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(kind)
    flat = flat.fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09 to 0x0D."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]
