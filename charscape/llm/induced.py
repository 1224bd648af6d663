"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations.

The usual induction scans a suffix array slot by slot. Here a scan takes all slots up to the next one
that is still empty at once: each of these is final, so their predecessors can be put into their
buckets together, in order. A scan over bytes takes a few steps per bucket. The leftmost-smaller
substrings are compared directly, many items at once, instead of by an induction of their own.
"""

from __future__ import annotations

import numpy as np


def _next_set(flags: np.ndarray, at: int) -> int:
    """First place from `at` on with a set flag; the length if there is none."""
    step, n = 1024, len(flags)
    while at < n:
        part = flags[at:at + step]
        hit = int(part.argmax())
        if part[hit]:
            return at + hit
        at += step
        step *= 2
    return n


def _deal(keys: np.ndarray, items: np.ndarray, free: np.ndarray, step: int, order: np.ndarray,
          few: bool) -> np.ndarray:
    """Puts items into the next free slots of their buckets, in order; the slots taken."""
    by_key = np.argsort(keys.astype(np.uint16) if few else keys, kind="stable")
    keys = keys[by_key]
    first = np.empty(len(keys), bool)
    first[0] = True
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    at = np.flatnonzero(first)
    counts = np.empty(len(at), np.int64)
    counts[:-1] = at[1:] - at[:-1]
    counts[-1] = len(keys) - at[-1]
    bucket = keys[at]
    slots = np.repeat(free[bucket] - step * at, counts) + step * np.arange(len(keys))
    order[slots] = items[by_key]
    free[bucket] += step * counts
    return slots


def _induce(s: np.ndarray, small: np.ndarray, counts: np.ndarray, starts: np.ndarray,
            seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given `seeds`, the leftmost-smaller suffixes in order."""
    n, few = len(s), len(counts) <= 1 << 16
    n_large = counts - np.bincount(s[small], minlength=len(counts))
    order = np.full(n, -1, s.dtype)
    order[0] = n - 1  # the end mark
    # Seeds go to the ends of their buckets, in order.
    keys = s[seeds]
    _deal(keys, seeds, starts + counts - np.bincount(keys, minlength=len(counts)), 1, order, few)

    # Larger suffixes, upwards: they fill the fronts of the buckets.
    pending = np.arange(n, dtype=s.dtype) < np.repeat((starts + n_large).astype(s.dtype), counts)
    larger = pending.copy()
    free = starts.copy()
    at = 0
    while at < n:
        stop = _next_set(pending, at)
        done = order[at:stop]
        done = done[done > 0] - 1
        done = done[~small[done]]
        if len(done):
            pending[_deal(s[done], done, free, 1, order, few)] = False
        elif stop == at:
            raise AssertionError("no progress")
        at = stop
    # Smaller suffixes, downwards, over the seeds, which are found again.
    pending = ~larger[::-1]
    order[~larger] = -1
    order[0] = n - 1
    pending[n - 1] = False
    free = starts + counts - 1
    at = 0
    while at < n:
        stop = _next_set(pending, at)
        done = order[n - stop:n - at][::-1]
        done = done[done > 0] - 1
        done = done[small[done]]
        if len(done):
            pending[n - 1 - _deal(s[done], done, free, -1, order, few)] = False
        elif stop == at:
            raise AssertionError("no progress")
        at = stop
    return order


def _substring_order(s: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the leftmost-smaller substrings in order, and names by that order: equal ones share one.

    A substring reaches the start of the next. Of equal items, the larger kind comes first. With the kind
    in an item's last bit, no substring is the start of another, so several items at once can be compared
    as one number; only substrings that agree so far are looked at again.
    """
    ends = np.append(seeds[1:], len(s) - 1)
    items = 2 * s.astype(np.uint64) + small
    bits = max(1, int(items.max()).bit_length())
    width = max(1, 64 // bits)
    shifts = (np.arange(width, dtype=np.uint64) * np.uint64(bits))[::-1]

    def word(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for t in range(width):
            place = at + t
            out |= np.where(place <= end, items[np.minimum(place, end)], 0) << shifts[t]
        return out

    ranked = np.arange(len(seeds))
    first = np.ones(len(seeds), bool)  # starts a group of substrings that agree so far
    first[1:] = False
    tied, step = np.arange(len(seeds)), 0  # places in `ranked` of groups that go on
    while len(tied):
        group = np.cumsum(first[tied])
        own = ranked[tied]
        values = word(seeds[own] + step, ends[own])
        by_value = np.lexsort((values, group)) if step else np.argsort(values, kind="stable")
        values, own = values[by_value], own[by_value]
        ranked[tied] = own
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (values[1:] != values[:-1]) | first[tied[1:]]
        first[tied] = fresh
        step += width
        several = ~fresh
        several[:-1] |= ~fresh[1:]
        tied = tied[several & (seeds[own] + step <= ends[own])]
    return ranked, np.cumsum(first) - 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, whose last item is 0 and the only 0."""
    n = len(s)
    kind = np.int32 if n < 1 << 31 else np.int64
    s = s.astype(kind, copy=False)
    if n <= 2:
        return np.arange(n, dtype=kind)[::-1].copy()
    counts = np.bincount(s)
    starts = np.cumsum(counts) - counts
    # A suffix is small if it is less than the next one; equal items follow their run's end.
    less = np.empty(n, np.int8)
    less[:-1] = np.sign(s[1:] - s[:-1])
    less[-1] = 1
    source = np.where(less != 0, np.arange(n, dtype=kind), n)
    source = np.minimum.accumulate(source[::-1])[::-1]
    small = less[source] > 0
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ranked, names = _substring_order(s, small, seeds)
    if len(names) and names[-1] + 1 < len(seeds):
        reduced = np.empty(len(seeds), kind)
        reduced[ranked] = names
        ranked = suffix_array(reduced)
    return _induce(s, small, counts, starts, seeds[ranked])


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By text place: length of the prefix shared with the suffix before it in the order.

    Where the items before two neighbours agree, the value is one less than at the place before; only
    the other places are compared.
    """
    n = len(s)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    place = np.arange(n, dtype=order.dtype)
    follows = np.zeros(n, bool)
    inner = (place > 0) & (before > 0)
    follows[inner] = s[place[inner] - 1] == s[before[inner] - 1]
    out = np.zeros(n, order.dtype)
    active = np.flatnonzero(~follows & (before >= 0))
    # Several items are compared at once, packed into a number; the end mark ends every comparison.
    bits = max(1, int(s.max()).bit_length())
    width = max(1, 63 // bits)
    packed = np.zeros(n, np.uint64)
    for t in range(min(width, n)):
        packed[:n - t] |= s[t:].astype(np.uint64) << np.uint64(bits * t)
    step = 0
    while len(active):
        differs = packed[active + step] ^ packed[before[active] + step]
        ended = differs != 0
        lowest = differs[ended]
        lowest &= ~lowest + np.uint64(1)
        out[active[ended]] = step + np.log2(lowest.astype(np.float64)).astype(np.int64) // bits
        active = active[~ended]
        step += width
    origin = np.maximum.accumulate(np.where(follows, 0, place))
    return np.where(follows, np.maximum(out[origin] - (place - origin), 0), out)
