"""Suffix arrays by linear grouping, without recursion or renaming.

Suffixes start in groups by their first symbol. The groups are processed in descending order. A group's suffixes share a Lyndon
prefix; each finds the nearest earlier suffix of a lower group by its previous-smaller pointer, and that one's prefix
grows by the group's prefix, as often as suffixes of the group lead to it. So such suffixes split off
upwards from their group, the more often the higher. In the end each group is a Lyndon prefix. Then the suffixes are emitted in
order: each one found puts the suffixes whose Lyndon prefixes end where it begins, along the previous-smaller pointers, into the next
places of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a sequence of integers in ascending order; an end counts as less than any symbol."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.append(np.asarray(text) - np.min(text) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    start_of = np.repeat(starts, np.diff(np.append(starts, n + 1)))  # by place
    group = np.empty(n + 1, np.int64)
    group[order] = start_of
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n + 1)
    previous = _group(order.tolist(), place.tolist(), group_list := group.tolist(), np.bincount(start_of, minlength=n + 1).tolist())
    return np.array(_emit(group_list, previous)[1:], np.int64)


def _group(sa: list[int], place: list[int], group: list[int], size: list[int]) -> list[int]:
    """Refines `group` (the first place of each suffix's group) to groups of Lyndon prefixes; returns the previous-smaller pointers.

    sa holds the groups one after another, place is its inverse, and size has a group's size at its first place.
    """
    previous = [-1] * len(sa)
    last = len(sa) - 1
    while last >= 0:
        begin = group[sa[last]]
        led: dict[int, int] = {}
        for i in sorted(sa[begin : last + 1]) if last > begin else (sa[begin],):
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                led[p] = led.get(p, 0) + 1
        if len(led) == 1:
            by_count = [list(led)]
        else:
            counts: dict[int, list[int]] = {}
            for p, k in led.items():
                counts.setdefault(k, []).append(p)
            by_count = [counts[k] for k in sorted(counts, reverse=True)]
        for moving in by_count:
            ends: dict[int, int] = {}
            for p in moving:  # to the end of its group, before those that moved already
                g = group[p]
                end = ends.get(g)
                if end is None:
                    end = g + size[g]
                end -= 1
                ends[g] = end
                at, other = place[p], sa[end]
                sa[at], sa[end] = other, p
                place[other], place[p] = at, end
            for p in moving:
                g = group[p]
                end = ends[g]
                if end == g:
                    continue  # the whole group moves, which changes nothing
                group[p] = end
            for g, end in ends.items():
                if end != g:
                    size[end] = g + size[g] - end
                    size[g] = end - g
        last = begin - 1
    return previous


def _emit(group: list[int], previous: list[int]) -> list[int]:
    n = len(group)
    out = [-1] * n
    front = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    front[0] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = previous[s]
    return out


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the array but the first, how many symbols its suffix shares with the one before it; 0 at the first."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    t, order, place, out, k = np.asarray(text).tolist(), sa.tolist(), rank.tolist(), [0] * n, 0
    for i in range(n):
        r = place[i]
        if not r:
            k = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while k < most and t[i + k] == t[j + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return np.array(out, np.int64)
