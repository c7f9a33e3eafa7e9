"""Suffix array by the linear grouping construction.

Phase 1 groups suffixes by their longest Lyndon prefix.  Groups start as equal
first symbols and are processed from the largest down: every suffix of the
group points to the nearest earlier suffix in a smaller group (its previous smaller
suffix), and the suffixes pointed to move, within their old group, behind the
others; those pointed to more often move further.  Phase 2 walks the array from the
smallest suffix on and emits the suffix in front of each entry, then its chain of
previous-smaller pointers, at the next free place of their groups.  No renaming
and no recursion is needed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative integers (an end smaller than all is implied)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = np.concatenate([np.asarray(text, dtype=np.int64) + 1, [0]])  # the end as a symbol of its own
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.diff(text[order], prepend=-1))
    sa = order.tolist()
    place = np.empty(n + 1, dtype=np.int64)
    place[order] = np.arange(n + 1)
    place = place.tolist()
    start = np.empty(n + 1, dtype=np.int64)
    start[order] = np.repeat(first, np.diff(first, append=n + 1))
    start = start.tolist()
    size = dict(zip(first.tolist(), np.diff(first, append=n + 1).tolist()))
    before = [-1] * (n + 1)

    end = n
    while end >= 0:  # groups from the largest down
        low = start[sa[end]]
        group = sa[low: end + 1]
        if len(group) > 1:
            group.sort()  # a member's pointer may pass over earlier members
        children: dict[int, int] = {}
        for i in group:
            j = i - 1
            while j >= 0 and start[j] >= low:  # larger groups and earlier members have their pointers
                j = before[j]
            before[i] = j
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        moves: dict[int, list[tuple[int, int]]] = {}
        for j, count in children.items():
            moves.setdefault(start[j], []).append((count, j))
        for old, members in moves.items():
            if len(members) > 1:
                members.sort(reverse=True)
            free = old + size[old]
            at = 0
            while at < len(members):  # equal counts form one new group, larger counts further back
                count = members[at][0]
                upper = free
                while at < len(members) and members[at][0] == count:
                    j = members[at][1]
                    free -= 1
                    p, other = place[j], sa[free]
                    sa[p], place[other] = other, p
                    sa[free], place[j] = j, free
                    at += 1
                size[free] = upper - free
                for p in range(free, upper):
                    start[sa[p]] = free
            if free > old:
                size[old] = free - old
        end = low - 1

    out = [-1] * (n + 1)
    out[0] = n
    fill = {g: g for g in size}
    done = [False] * (n + 1)
    done[n] = True
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            out[fill[g]] = j
            fill[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out[1:])
