"""Re-Pair grammars over word ids, and the periodic runs found on them.

All texts of a batch share one grammar. A round replaces every pair that occurs twice or
more and beats the pairs it overlaps (more frequent first); what no pair shortens any
more is joined to one balanced tree a text. So each text is one symbol, and every run of
equal periods crosses the boundary of the lowest node that holds it. Runs that cross a
boundary are computed once a symbol, at its first place, and moved to all its places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 19
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """``left`` words and ``size`` words of every rule, and all places of the rules in the texts."""

    left: np.ndarray
    size: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each key, and how often each occurs."""
    return np.unique(key, return_inverse=True, return_counts=True)


def _winners(code: np.ndarray, count: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Places whose pair is replaced: more frequent than the pairs left and right of it.

    Ties go by a scrambled code, so that no long chain waits for its end. Of the pairs of
    a stretch of one repeated symbol every second one is taken.
    """
    order = np.lexsort((np.arange(len(count), dtype=np.uint64) * SCRAMBLE, count))
    rank = np.empty(len(count), np.int64)
    rank[order] = np.arange(1, len(count) + 1)
    weight = np.where(joined & (count[code] > 1), rank[code], 0)
    first = np.r_[True, weight[1:] != weight[:-1]]
    at = np.arange(len(weight))
    even = (at - at[first][np.cumsum(first) - 1]) % 2 == 0
    before, after = np.r_[0, weight[:-1]], np.r_[weight[1:], 0]
    return np.flatnonzero((weight > 0) & even & (weight >= before) & (weight >= after))


def grammar(words: np.ndarray, text: np.ndarray) -> Grammar:
    """The grammar of texts given as word ids in a row and the text number of each word."""
    symbol, owner = words.astype(np.int64), text
    place, size = np.arange(len(words)), np.ones(len(words), np.int64)
    free, made = int(symbol.max(initial=-1)) + 1, 0
    lefts, sizes, rules, places = [], [], [], []
    paired = True
    while len(symbol) > 1:
        joined = owner[1:] == owner[:-1]
        if not joined.any():
            break
        if paired:
            # A pair across texts has a key of its own, which joins nothing.
            low, high = symbol[:-1], symbol[1:]
            _, code, count = _named(np.where(joined, low * (free + made) + high, -1))
            chosen = _winners(code, count, joined)
            paired = len(chosen) > 0
        if not paired:
            first = np.r_[True, ~joined]
            at = np.arange(len(symbol))
            odd = (at - at[first][np.cumsum(first) - 1]) % 2
            chosen = np.flatnonzero(joined & (odd[:-1] == 0))
            code = np.arange(len(symbol) - 1)
        _, own, number = np.unique(code[chosen], return_index=True, return_inverse=True)
        lefts.append(size[chosen][own])
        sizes.append((size[chosen] + size[chosen + 1])[own])
        rules.append(number + made)
        places.append(place[chosen])
        symbol[chosen] = number + free + made
        size[chosen] += size[chosen + 1]
        made += len(own)
        kept = np.ones(len(symbol), bool)
        kept[chosen + 1] = False
        symbol, owner, place, size = symbol[kept], owner[kept], place[kept], size[kept]
    empty = [np.zeros(0, np.int64)]
    return Grammar(*(np.concatenate(x or empty) for x in (lefts, sizes, rules, places)))


def stretch_names(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place, equal for equal words of one text.

    Ends with the first length at which no text holds a stretch twice. Stretches that
    leave their text have names of their own.
    """
    n = len(words)
    _, name, count = _named(text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
    names, length = [name.astype(np.int32)], 1
    last = np.searchsorted(text, text, "right")
    while (count > 1).any():
        at = np.arange(n)
        other = np.minimum(at + length, n - 1)
        inside = at + 2 * length <= last
        key = np.where(inside, name.astype(np.int64) * n + name[other], -1 - at)
        _, name, count = _named(key)
        names.append(name.astype(np.int32))
        length *= 2
    return names


def _extended(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on, and how many before them, agree within [low, high); i < j."""
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    top = len(names[0]) - 1
    for level in range(len(names) - 1, -1, -1):
        step, name = 1 << level, names[level]
        a, b = i + ahead, j + ahead
        fits = b + step <= high
        equal = fits & (name[np.minimum(a, top)] == name[np.minimum(b, top)])
        ahead += step * equal
        a, b = i - behind - step, j - behind - step
        fits = a >= low
        equal = fits & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
        behind += step * equal
    return ahead, behind


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of every number from start to end of each row."""
    many = np.maximum(end - start, 0)
    row = np.repeat(np.arange(len(start)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, start[row] + at


def _smallest_period(node: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows of the smallest period of each (node, start, end)."""
    order = np.lexsort((period, end, start, node))
    a, b, c = node[order], start[order], end[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]] if len(order) else order


def crossing_runs(names: list[np.ndarray], text: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, least: int, powers: int) -> tuple[np.ndarray, ...]:
    """node, start, end, period of the runs inside [low, high) that cross ``mid``.

    Words q apart agree over ``least`` - q words or more, and over (``powers`` - 1) q or more,
    so at least ``seed`` of them lie on one side of ``mid``: the words there occur again q
    words on or back, which gives the periods to try.
    """
    seed = max(1, least // 4)
    n = len(text)
    last = np.searchsorted(text, text, "right")
    # Names of stretches of ``seed`` words: two overlapping stretches of a power of two.
    level = min(seed.bit_length() - 1, len(names) - 1)
    shift = seed - (1 << level)
    at = np.arange(n)
    key = names[level].astype(np.int64) * n + names[level][np.minimum(at + shift, n - 1)]
    _, gram = np.unique(np.where(at + seed <= last, key, -1 - at), return_inverse=True)
    gram = gram.astype(np.int64)
    order = np.argsort(gram, kind="stable")
    index = gram[order] * n + order
    out = []
    node = np.flatnonzero(high - low >= least)
    for back in (0, seed):
        own = node[(mid[node] - back >= low[node]) & (mid[node] - back + seed <= high[node])]
        probe = mid[own] - back
        first = np.searchsorted(index, gram[probe] * n + low[own])
        end = np.searchsorted(index, gram[probe] * n + high[own] - seed, "right")
        cuts = np.flatnonzero(np.r_[True, np.diff(np.cumsum(end - first) // CHUNK) > 0, True][: len(own) + 1])
        for a, b in zip(cuts, [*cuts[1:], len(own)]):
            row, hit = _spans(first[a:b], end[a:b])
            row, hit = row + a, order[hit]
            period = np.abs(hit - probe[row])
            row, period, later = row[period > 0], period[period > 0], (hit > probe[row])[period > 0]
            x = own[row]
            i = np.where(later, mid[x], mid[x] - period)
            fits = (i >= low[x]) & (i + period <= high[x])
            x, i, period = x[fits], i[fits], period[fits]
            ahead, behind = _extended(names, i, i + period, low[x], high[x])
            start, stop = i - behind, i + period + ahead
            good = (stop - start >= np.maximum(least, powers * period)) & (start < mid[x]) & (stop > mid[x])
            out.append(tuple(v[good] for v in (x, start, stop, period)))
    found = tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    kept = _smallest_period(*found)
    return tuple(v[kept] for v in found)


def periodic_runs(words: np.ndarray, text: np.ndarray, least: int = 12, powers: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all maximal runs, by start and then period.

    ``words`` are ids in a row, ``text`` the ascending text number of each. A run is at
    least ``least`` words and ``powers`` periods long; places count over all texts.
    """
    nothing = (np.zeros(0, np.int64),) * 3
    if len(words) < least:
        return nothing
    rules = grammar(words, text)
    names = stretch_names(words, text)
    by_rule = np.argsort(rules.rule, kind="stable")
    bounds = np.searchsorted(rules.rule[by_rule], np.arange(len(rules.size) + 1))
    low = rules.place[by_rule[bounds[:-1]]]
    node, start, end, period = crossing_runs(names, text, low, low + rules.left, low + rules.size, least, powers)
    if not len(node):
        return nothing
    row, at = _spans(bounds[node], bounds[node + 1])
    moved = rules.place[by_rule[at]] - low[node[row]]
    start, end, period = start[row] + moved, end[row] + moved, period[row]
    # A run cut off at the end of a node lies within the whole run of a higher node.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    far = period * (len(words) + 1) + end
    whole = np.r_[True, far[1:] > np.maximum.accumulate(far)[:-1]]
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]
