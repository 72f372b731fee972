"""Matching blocks of two texts, the same that difflib finds, without its pairs of equal characters."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np

#: Runs of rare characters from this length are bounded by what the other text holds, shorter ones by their own length.
LONG = 64


def ratio(a: str, b: str) -> float:
    """`SequenceMatcher(None, a, b).ratio()`."""
    if a == b:
        return 1.0
    return 2.0 * matched(a, b) / (len(a) + len(b))


def matched(a: str, b: str) -> int:
    """How many characters difflib's matching blocks hold.

    Between two blocks comes the longest run of rare characters (of 200 or more, those that make up no more than a hundredth of b) that both
    texts hold there, the first in a, then in b; it grows on both sides as long as the texts are equal. Places of a are tried by how long
    such a run can be at most, so that the first one found in its gap is the longest there.
    """
    x, y = points(a), points(b)
    rare, counts = np.unique(y, return_counts=True)
    if len(y) >= 200:
        rare = rare[counts <= len(y) // 100 + 1]
    held = np.isin(x, rare)
    places, breaks = np.flatnonzero(held), np.append(np.flatnonzero(~held), len(x))
    most = breaks[np.searchsorted(breaks, places)] - places
    if most.max(initial=0) >= LONG:
        most = np.minimum(most, longest(np.where(held, x, -1), np.where(np.isin(y, rare), y, -1))[places])
    tries = defaultdict(list)
    for place, size in zip(places.tolist(), most.tolist(), strict=True):
        tries[size].append(place)
    starts, gaps, n = [0], [(0, len(x), 0, len(y))], 0
    for size in range(int(most.max(initial=0)), 0, -1):
        for i in sorted(tries.pop(size, ())):
            at = bisect_right(starts, i) - 1
            if at < 0 or i >= gaps[at][1]:
                continue  # in a block
            a_from, a_to, b_from, b_to = gaps[at]
            if i + size > a_to:
                tries[a_to - i].append(i)
                continue
            j = b.find(a[i : i + size], b_from, b_to)
            if j < 0:
                low, high = 0, size - 1  # what is there of it
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if b.find(a[i : i + mid], b_from, b_to) >= 0 else (low, mid - 1)
                tries[low].append(i)
                continue
            before, after = alike(x[a_from:i][::-1], y[b_from:j][::-1]), alike(x[i + size : a_to], y[j + size : b_to])
            n += before + size + after
            left, right = (a_from, i - before, b_from, j - before), (i + size + after, a_to, j + size + after, b_to)
            gaps[at : at + 1] = new = [g for g in (left, right) if g[0] < g[1] and g[2] < g[3]]
            starts[at : at + 1] = [g[0] for g in new]
    return n + sum(alike(x[a_from:a_to], y[b_from:b_to]) for a_from, a_to, b_from, b_to in gaps)  # without rare characters a gap's beginning counts


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def alike(x: np.ndarray, y: np.ndarray) -> int:
    """How long two arrays begin alike."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + len(differ), step * 4
    return n


def longest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place of x, the length of the longest run from there that y holds too; -1 equals nothing. By suffixes sorted through doubling."""
    s = np.concatenate([x, [-1], y]).astype(np.int64)
    n, lone = len(s), s < 0
    s[lone] = 0x110000 + np.arange(lone.sum())
    ranks = [np.unique(s, return_inverse=True)[1]]
    while int(ranks[-1].max()) + 1 < n:
        width, after = 1 << (len(ranks) - 1), np.zeros(n, np.int64)
        after[:-width] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1])
    order = np.argsort(ranks[-1])
    ours, theirs, at = order < len(x), order > len(x), np.arange(n)
    below, above = np.maximum.accumulate(np.where(theirs, at, -1)), np.minimum.accumulate(np.where(theirs, at, n)[::-1])[::-1]
    found = np.zeros(len(x), np.int64)
    for near, there in ((below, below >= 0), (above, above < n)):
        i, j, size = order[ours & there], order[near[ours & there]], np.zeros((ours & there).sum(), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(i, j) + size < n
            to_i, to_j = np.where(inside, i + size, 0), np.where(inside, j + size, 0)
            size += (inside & (ranks[k][to_i] == ranks[k][to_j])).astype(np.int64) << k
        np.maximum.at(found, i, size)
    return found
