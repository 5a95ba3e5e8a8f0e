"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then emission.

Grouping.  Every suffix starts in the group of its first symbol.  Groups are taken from the
highest down.  When a group is taken, the common prefix of its members is their longest Lyndon
prefix, and it ends where their next smaller suffix begins.  Each member finds the nearest place to
its left that hasn't been taken (its previous smaller suffix); what stands there is followed by
the group's prefix, so it rises just above its group: the more copies follow it, the higher.
Nothing is renamed, and no group is sorted again.

Emission.  Within a group, suffixes are in the order of the suffixes that follow their prefixes.
Going through the array from its front, each suffix met puts those whose prefix ends at it into
the next free place of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of an array of small non-negative integers, in lexicographic order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    alphabet, first = np.unique(symbols, return_inverse=True)
    group = first.tolist()
    by_symbol = np.argsort(first, kind="stable")
    members: list[list[int]] = [part.tolist() for part in np.split(by_symbol, np.cumsum(np.bincount(first))[:-1])]
    live = [len(m) for m in members]  # members that haven't risen
    length = [1] * len(alphabet)
    below = list(range(-1, len(alphabet) - 1))  # the next lower and next higher group
    above = list(range(1, len(alphabet) + 1))
    ends = [0] * n  # where the Lyndon prefix of each suffix ends
    left = list(range(-1, n))  # left[i + 1]: i, or a place nearer to the nearest one that hasn't been taken
    order: list[int] = []  # groups as taken
    g = len(alphabet) - 1
    while g >= 0:
        if not live[g]:
            members[g] = []
            g = below[g]
            continue
        size = length[g]
        own = members[g]
        if live[g] < len(own):
            own = members[g] = [i for i in own if group[i] == g]
        order.append(g)
        for i in own:
            left[i + 1] = i - 1
            ends[i] = i + size
        smaller = []
        for i in own:
            p = left[i]
            q = left[p + 1]
            if q != p:
                seen = [i]
                while q != p:
                    seen.append(p + 1)
                    p = q
                    q = left[p + 1]
                for s in seen:
                    left[s] = p
                left[i + 1] = p
            if p >= 0:
                smaller.append(p)
        if not smaller:
            g = below[g]
            continue
        # A place found k times in a row is followed by k copies of the group's prefix.
        if len(smaller) == 1:
            risen = {(group[smaller[0]], 1): smaller}
        else:
            times: dict[int, int] = {}
            for p in smaller:
                times[p] = times.get(p, 0) + 1
            risen = {}
            for p, k in times.items():
                key = (group[p], k)
                if key in risen:
                    risen[key].append(p)
                else:
                    risen[key] = [p]
        last = (-1, -1)  # the last group split and what was put above it
        for (h, k), moved in sorted(risen.items()) if len(risen) > 1 else risen.items():
            if live[h] == len(moved) and last[0] != h:  # all rise alike: the group itself grows
                length[h] += k * size
                members[h] = moved
                continue
            # Ascending in the number of copies: each goes right above those of fewer copies.
            low = last[1] if last[0] == h else h
            new = len(members)
            last = (h, new)
            members.append(moved)
            live.append(len(moved))
            live[h] -= len(moved)
            length.append(length[h] + k * size)
            for p in moved:
                group[p] = new
            up = above[low]
            above.append(up)
            below.append(low)
            above[low] = new
            below[up] = new
        g = below[g]
    return _emit(n, group, members, order, ends)


def _emit(n: int, group: list[int], members: list[list[int]], order: list[int], ends: list[int]) -> np.ndarray:
    free = [0] * len(members)
    at = 0
    for g in reversed(order):
        free[g] = at
        at += len(members[g])
    first, following = [-1] * (n + 1), [-1] * n  # suffixes by the place where their prefix ends
    for i, e in enumerate(ends):
        following[i] = first[e]
        first[e] = i
    out = [-1] * n
    i = n  # the empty suffix comes before all
    k = 0
    while True:
        s = first[i]
        while s >= 0:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = following[s]
        if k == n:
            return np.array(out, np.int64)
        i = out[k]
        k += 1
