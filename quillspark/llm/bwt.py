"""Repeated strings by breadth-first interval expansion on a Burrows-Wheeler transform.

The transform of a text is built from its suffixes in order.  Starting from
the intervals of single symbols, intervals are extended backward by one
symbol at a time, breadth first, so boundaries between suffixes get their
common-prefix value in increasing order.  The search stops at the wanted
length: boundaries without a value by then lie between suffixes that share
at least that many symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions in the order of the ``depth`` or more symbols from there on; common prefixes of neighbours up to a few symbols, and how many.

    Symbol 0 is an end mark: each is taken for a symbol of its own, so
    suffixes that reach one within ``depth`` symbols tie with none.
    """
    n, span = len(text), 1
    present = np.zeros(int(text.max()) + 1, np.int64)
    present[text] = present[0] = 1
    rank = (np.cumsum(present) - 1)[text]  # symbols numbered without gaps; 0 stays the end mark
    ends = text == 0
    while True:
        bits = max(int(rank.max()).bit_length(), 1)
        take = max(62 // bits, 2)
        key = rank.copy()
        for k in range(1, take):
            key <<= bits
            key[: max(n - k * span, 0)] |= rank[k * span :]
        order = np.argsort(key).astype(np.int32)
        if span == 1:
            packed, width, step = key, take, bits
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        if span == 1:
            # Symbols before the next end mark, as far as the key reaches.
            free = np.full(n, take, np.int8)
            free[max(n - take + 1, 0) :] = 0
            at = np.flatnonzero(ends)
            for k in range(take - 1, -1, -1):
                free[at[at >= k] - k] = k
            fresh |= (free < take)[order]
        span *= take
        if span >= depth or fresh.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
    differ = packed[order]
    differ = differ[1:] ^ differ[:-1]
    common = np.zeros(n - 1, np.int8)
    for k in range(width):
        common += differ < (1 << (step * (width - 1 - k)))
    free = free[order]
    return order, np.minimum(common, np.minimum(free[1:], free[:-1])), width


def _start(known: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Start of the interval that ends at each new boundary: the known boundary before it."""
    lower = new - 1
    open_ = np.flatnonzero(~known[lower])
    for _ in range(256):
        if not len(open_):
            return lower
        lower[open_] -= 1
        open_ = open_[~known[lower[open_]]]
    set_ = np.flatnonzero(known)
    return set_[np.searchsorted(set_, new) - 1]


def repeated_runs(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group): starts of strings of ``length`` symbols that occur more than once, and a number for each string.

    Negative symbols end strings; no string reaches over one.
    """
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.maximum(text.astype(np.int32) + 1, 0)
    order, common, width = suffix_order(symbols, length + 1)
    before = symbols[order - 1].astype(np.uint16)  # the transform; the text is taken as a ring
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_symbol] = np.arange(n)  # row of the suffix one symbol longer
    following = np.full(n, n, np.int32)  # next row with the same symbol before it
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, bool)
    # The sort's first key tells the shortest common prefixes; the widest intervals need no expansion.
    seed = min(width, length)
    known[0] = known[n] = True
    known[1:n] = common < seed
    new = np.append(np.flatnonzero(common == seed - 1) + 1, n)
    for _ in range(seed - 1, length - 1):
        known[new] = True
        if not len(new):
            break
        lower = _start(known, new)
        size = new - lower
        rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lower, size)
        last = following[rows] >= np.repeat(new, size)
        found = step[rows[last]] + 1
        new = np.unique(found[~known[found]])
    known[new] = True
    bounds = np.flatnonzero(known)
    sizes = np.diff(bounds)
    many = sizes > 1
    group = np.repeat(np.flatnonzero(many), sizes[many])
    rows = np.arange(len(group)) - np.repeat(np.cumsum(sizes[many]) - sizes[many] - bounds[:-1][many], sizes[many])
    return order[rows], group
