"""Suffix array by linear grouping: Lyndon groups in descending order, then one pass of induction.

The suffixes start in groups by first symbol. Groups are taken from the highest
down. For every suffix of a group the nearest suffix to the left that stands in
a lower group is found with previous-smaller pointers; those suffixes are
refined by how many of the group point at them, more being higher, and move to
new groups right above their old ones. After that the suffixes of a group share
their longest Lyndon prefix, and the groups are in order; following the pointers
from the sorted suffixes outwards puts each group's members in order, with no
renaming and no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start of every suffix of ``symbols`` (integers) in lexicographic order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    # the end of the string is a symbol below all others
    ranks = np.concatenate([np.unique(symbols, return_inverse=True)[1].reshape(-1) + 1, [0]])
    placed = np.argsort(ranks, kind="stable")
    counts = np.bincount(ranks)
    starts = np.cumsum(counts) - counts
    order = placed.tolist()
    where = np.empty(n + 1, np.int64)
    where[placed] = np.arange(n + 1)
    where = where.tolist()
    group = starts[ranks].tolist()  # first place of a suffix's group
    size = [0] * (n + 1)
    for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
        size[start] = count
    previous = [-1] * (n + 1)

    high = n + 1
    while high > 0:
        start = group[order[high - 1]]
        members = order[start:high]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for suffix in members:
            p = suffix - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[suffix] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        high = start
        if not pointed:
            continue
        most = max(pointed.values())
        if most == 1:
            layers = [list(pointed)]
        else:
            layers = [[] for _ in range(most)]
            for p, times in pointed.items():
                layers[most - times].append(p)
        for layer in layers:
            moved: dict[int, int] = {}
            for p in layer:  # to the upper end of its group
                old = group[p]
                done = moved.get(old, 0) + 1
                moved[old] = done
                end = old + size[old] - done
                at, other = where[p], order[end]
                order[at], order[end] = other, p
                where[other], where[p] = at, end
            for old, count in moved.items():
                left = size[old] - count
                if left:
                    size[old] = left
                    fresh = old + left
                    size[fresh] = count
                    for i in range(fresh, fresh + count):
                        group[order[i]] = fresh

    result = [-1] * (n + 1)
    filled = [0] * (n + 1)
    seen = bytearray(n + 1)
    result[0] = n
    seen[n] = 1
    for i in range(n + 1):
        suffix = result[i] - 1
        while suffix >= 0 and not seen[suffix]:
            seen[suffix] = 1
            at = group[suffix]
            result[at + filled[at]] = suffix
            filled[at] += 1
            suffix = previous[suffix]
    return np.array(result[1:], np.int64)
