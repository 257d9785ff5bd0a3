"""Burrows-Wheeler transform of a byte string and common prefixes by interval expansion."""

from __future__ import annotations

import numpy as np

#: Symbols (9 bits each) that fit the first sorting key.
PACKED = 7


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first `depth` symbols; the last symbol is a unique 0."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(PACKED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(PACKED):
        key = (key << np.uint64(9)) | padded[k : n + k]
    width = PACKED
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.uint64)
        key = rank << np.uint64(32)
        if width < n:
            key[: n - width] |= rank[width:] + np.uint64(1)
        width *= 2


def transform(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol before each suffix, its place in the order by backward extension, and where each symbol's suffixes begin."""
    before = symbols[order - 1]  # of the whole string, the last symbol comes before
    back = np.empty(len(order), np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(len(order))
    return before, back, np.concatenate([[0], np.cumsum(np.bincount(before, minlength=257))])


def prefix_breaks(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a byte string, and whether each suffix shares fewer than `least` bytes with the one before it.

    The intervals of all strings of length 0, 1, 2, ... are extended backwards by one symbol, breadth
    first. An interval of length m + 1 that ends before a suffix whose common prefix is not known yet
    shows that this prefix has m symbols; intervals that show nothing new are dropped. The expansion
    stops at length `least`: what is still unknown then shares at least so many symbols.
    """
    symbols = np.concatenate([text.astype(np.uint16) + 1, np.zeros(1, np.uint16)])
    order = suffix_order(symbols, least + 1)
    before, back, begins = transform(symbols, order)
    n = len(symbols)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    first_of_symbol = np.zeros(n + 1, bool)
    first_of_symbol[begins[begins <= n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(total)
        owner = np.repeat(np.arange(len(low)), size)
        # the extensions of one interval by one symbol are neighbours in the order
        if total > n // 6:
            mark = np.full(n, -1, np.int64)
            mark[back[rows]] = owner
            breaks = np.empty(n, bool)
            breaks[0] = True
            np.not_equal(mark[1:], mark[:-1], out=breaks[1:])
            breaks |= first_of_symbol[:n]
            starts = np.flatnonzero(breaks)
            ends = np.append(starts[1:], n)
            real = mark[starts] >= 0
            starts, ends = starts[real], ends[real]
        else:
            to = back[rows]
            by = np.argsort(to)
            to, owner = to[by], owner[by]
            breaks = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | first_of_symbol[to[1:]]])
            heads = np.flatnonzero(breaks)
            starts, ends = to[heads], to[np.append(heads[1:], len(to)) - 1] + 1
        new = ~known[ends]
        low, high = starts[new], ends[new]
        known[high] = True
    return order, known[:n]


def repeat_groups(text: np.ndarray, least: int) -> np.ndarray:
    """For each position, a number that positions share whose next `least` bytes are equal.

    Numbers of the last `least` - 1 positions mean nothing.
    """
    order, breaks = prefix_breaks(text, least)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:-1]
