"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest prefix that is a Lyndon word, and the
groups refined from the largest to the smallest: a suffix whose next smaller
one to the left is j makes j's prefix longer by its own, so all such j leave
their group for one right above it. When every group has been processed, one
pass over the order from its start emits the suffixes of each group, in order
(Baier, "Linear-time Suffix Sorting", CPM 2016).
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(codes: Sequence[int]) -> tuple[list[int], list[int]]:
    """(group, smaller) of each suffix of ``codes``.

    ``group`` is the first place of the suffix's group in the order,
    ``smaller`` the nearest place to the left whose group is lower, or -1. The
    last code has to be smaller than all others.
    """
    n = len(codes)
    order = sorted(range(n), key=codes.__getitem__)
    place, group = [0] * n, [0] * n
    ends = [0] * n  # of the group that begins here
    first, last = 0, None
    for at, suffix in enumerate(order):
        if codes[suffix] != last:
            last, first = codes[suffix], at
        place[suffix] = at
        group[suffix] = first
        ends[first] = at + 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            # one suffix: at most one other gets a longer prefix
            j = order[start] - 1
            while j >= 0 and group[j] > start:
                j = smaller[j]
            smaller[order[start]] = j
            if j >= 0:
                old = group[j]
                to = ends[old] - 1
                if to > old:
                    at, other = place[j], order[to]
                    order[at], order[to] = other, j
                    place[other], place[j] = at, to
                    ends[old], group[j], ends[to] = to, to, to + 1
            end = start
            continue
        members = order[start:end]
        members.sort()
        pointers: dict[int, int] = {}
        for suffix in members:
            j = suffix - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]  # known: higher groups are done, and members further left too
            smaller[suffix] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        # the more often pointed to, the larger: they take the last places of their group first
        by_count: dict[int, list[int]] = {}
        for j, count in pointers.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[count]:
                old = group[j]
                to = ends[old] - 1
                at, other = place[j], order[to]
                order[at], order[to] = other, j
                place[other], place[j] = at, to
                ends[old] = to
                moved.setdefault(old, to + 1)
            for j in by_count[count]:
                old = group[j]
                group[j] = ends[old]
            for old, new_end in moved.items():
                ends[ends[old]] = new_end
        end = start
    return group, smaller


def suffix_array(codes: Sequence[int]) -> list[int]:
    """The suffixes of ``codes`` in order. The last code has to be smaller than all others."""
    n = len(codes)
    group, smaller = lyndon_groups(codes)
    order = [-1] * n
    free = list(range(n))  # the next place of the group that begins here
    done = bytearray(n)
    order[0] = n - 1
    done[n - 1] = 1
    for at in range(n):
        j = order[at] - 1
        while j >= 0 and not done[j]:
            first = group[j]
            order[free[first]] = j
            free[first] += 1
            done[j] = 1
            j = smaller[j]
    return order
