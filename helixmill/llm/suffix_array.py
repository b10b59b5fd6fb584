"""Linear suffix sorting by grouping on Lyndon prefixes.

First suffixes are put into groups by their first byte. Groups are taken from the largest to the smallest: each member's
pointer to the previous smaller suffix names a suffix whose known prefix the member's prefix extends, so the suffixes
pointed at move to new groups just above their old ones (further up, the more often they are pointed at). In the end a
group is all suffixes with the same longest Lyndon prefix, and one pass from the smallest suffix on emits the order inside
the groups along the same pointers, without renaming or recursion.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in ascending order. The last number must be smaller than all others."""
    n = len(text)
    if n == 0:
        return []
    place = sorted(range(n), key=text.__getitem__)
    where = [0] * n
    group = [0] * n  # where the suffix's group starts in `place`
    end = [0] * n  # for each start of a group, its last place
    start = 0
    for at, s in enumerate(place):
        if text[s] != text[place[start]]:
            start = at
        where[s], group[s], end[start] = at, start, at
    before = [-1] * n
    last = n - 1
    while last > 0:
        start = group[place[last]]
        if start == last:  # alone: no counting
            s = place[last]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                old = group[p]
                stop = end[old]
                if stop != old:
                    other, at = place[stop], where[p]
                    place[at], where[other], place[stop], where[p] = other, at, p, stop
                    group[p] = end[stop] = stop
                    end[old] = stop - 1
            last = start - 1
            continue
        members = sorted(place[start : last + 1])
        hits: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        if len(hits) == len(members) or len(hits) == 1:
            own: dict[int, list[int]] = {}
            for p in hits:
                own.setdefault(group[p], []).append(p)
            by_count[1] = own
        else:
            for p, k in hits.items():
                by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for old, moved in by_count[k].items():
                stop = end[old]
                new = stop - len(moved) + 1
                if new == old:
                    continue  # the whole rest of the group moves: it keeps its name
                for i, p in enumerate(moved):
                    at, other = where[p], place[stop - i]
                    place[at], where[other] = other, at
                    place[stop - i], where[p] = p, stop - i
                    group[p] = new
                end[old], end[new] = new - 1, stop
        last = start - 1
    out = [-1] * n
    free = list(range(n))  # for each start of a group, the next free place
    placed = bytearray(n)
    out[0] = place[0]
    placed[place[0]] = 1
    free[0] = 1
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out
