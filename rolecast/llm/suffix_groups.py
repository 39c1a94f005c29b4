"""Suffix sorting by groups of equal Lyndon prefixes, without renaming or recursion.

After Baier, "Linear-time Suffix Sorting - A New Approach for Suffix Array
Construction" (CPM 2016).

First phase: suffixes start in groups by their first symbol.  Groups are taken in
descending order.  For each suffix of a group, ``prev`` is the nearest suffix to
its left that is in a lower group; it is found by following the pointers that
higher groups have set already.  The suffixes that are pointed at leave their
group for a new one just above it, those with more pointers above those with
fewer.  In the end a group holds the suffixes with one Lyndon prefix.

Second phase: the array is read in ascending order.  Each suffix that is read puts
the suffix left of it, and that one's ``prev`` chain, at the front of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence whose last symbol is smaller than all others."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    _, first = np.unique(symbols, return_inverse=True)
    order = np.argsort(first, kind="stable")
    cuts = np.flatnonzero(np.diff(first[order])) + 1
    members: list[list[int]] = [part.tolist() for part in np.split(order, cuts)]
    group: list[int] = first.tolist()
    below: list[int] = list(range(-1, len(members) - 1))
    above: list[int] = list(range(1, len(members) + 1))
    above[-1] = -1
    prev = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        mine = members[g] = [i for i in members[g] if group[i] == g]
        hit: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            if j >= 0:
                hit[j] = hit.get(j, 0) + 1
        if hit:
            # Pointers within the group have all been followed, so what is hit lies in lower groups.
            counts = {1} if len(hit) == len(mine) else set(hit.values())
            for times in sorted(counts, reverse=True):
                fresh: dict[int, int] = {}
                for p in (hit if len(counts) == 1 else [p for p, k in hit.items() if k == times]):
                    h = group[p]
                    new = fresh.get(h)
                    if new is None:
                        new = fresh[h] = len(members)
                        members.append([])
                        up = above[h]
                        below.append(h)
                        above.append(up)
                        above[h] = new
                        if up >= 0:
                            below[up] = new
                    group[p] = new
                    members[new].append(p)
                for new in fresh.values():
                    members[new].sort()
        g = below[g]
    # Groups in ascending order, by the links.
    start = [0] * len(members)
    low = 0
    g = 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        start[g] = low
        low += len(members[g])
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    start[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(out, np.int64)
