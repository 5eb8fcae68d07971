"""Equal substrings of a block of texts: interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols of nine bits that fit into a sort key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (at least), by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(FIRST, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(FIRST):
        key = key << 9 | padded[i : i + n]
    known = FIRST
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        if known >= depth or rank[order[-1]] == n:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - known)] = rank[known:]
        key = rank * (n + 1) + ahead
        known *= 2


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in sorted order and, for each, the number of its class of equal ``length`` symbols.

    Symbol 0 ends a text: prefixes that hold it are not told apart. Strings are extended to
    the left, all of one length at a time: the rows of the transform inside the interval of
    a string, mapped to the rows of the longer strings, fall into the intervals of those.
    The end of an interval of a string of l + 1 symbols is a place where neighbours share
    l symbols, unless a shorter string ended there; only strings with a new end go on. No
    string longer than ``length`` is made: ends not found by then lie in equal prefixes.
    """
    n = len(text)
    order = suffix_array(text, length)
    before = text[order - 1]  # of suffix 0 this is the last symbol, an end
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    first = text[order]
    ends = np.zeros(n + 1, bool)
    ends[[0, n]] = True
    owner = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        width = high - low
        if not len(width):
            break
        interval = np.repeat(np.arange(len(low)), width)
        rows = np.arange(len(interval)) + np.repeat(low - (np.cumsum(width) - width), width)
        real = before[rows] != 0
        to = step[rows[real]]
        owner[to] = interval[real]
        to.sort()
        if not len(to):
            break
        starts = np.flatnonzero(
            np.concatenate([[True], (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]])])
        )
        stops = np.concatenate([starts[1:], [len(to)]])
        low, high = to[starts], to[stops - 1] + 1
        new = ~ends[high]
        ends[high] = True
        low, high = low[new], high[new]
    return order, np.cumsum(ends[:n])
