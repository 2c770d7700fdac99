"""Suffix arrays by linear grouping construction."""

from __future__ import annotations


def grouping_suffix_array(text: list[int]) -> list[int]:
    """Suffix order of ``text`` (small non-negative integers; a suffix that ends sooner is smaller).

    Phase 1 keeps suffixes in groups of equal Lyndon prefix, in order. Groups are processed from the highest down:
    each member gets its pointer to the previous suffix of a smaller group, and suffixes that the group points at
    move, by how often, to new groups right above their own. Phase 2 emits suffixes by rising rank: the one before
    an emitted suffix, and along its pointers, takes the next place of its group. Nothing is renamed or recursed on.
    """
    n = len(text) + 1  # the empty suffix at the end is the smallest
    t = [c + 1 for c in text]
    t.append(0)
    sa = sorted(range(n), key=t.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * n
    begin = 0
    for k, i in enumerate(sa):
        if k and t[i] != t[sa[k - 1]]:
            begin = k
        place[i], start[i] = k, begin
        size[begin] += 1
    prev, points = [-1] * n, [0] * n
    end = n
    while end > 0:
        g = start[sa[end - 1]]
        group = sa[g:end]
        if len(group) > 1:
            group.sort()
        pointed = []
        most = 0
        for i in group:
            p = i - 1
            while p >= 0 and start[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                if not points[p]:
                    pointed.append(p)
                points[p] += 1
                if points[p] > most:
                    most = points[p]
        if most == 1:
            levels = [pointed]
        else:
            by: dict[int, list[int]] = {}
            for p in pointed:
                by.setdefault(points[p], []).append(p)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:  # to the end of its group's stretch
                points[p] = 0
                s = start[p]
                k = moved.get(s, 0) + 1
                moved[s] = k
                at, to = place[p], s + size[s] - k
                other = sa[to]
                sa[at], sa[to] = other, p
                place[other], place[p] = at, to
            for s, k in moved.items():
                whole = size[s]
                if k < whole:
                    new = s + whole - k
                    size[s], size[new] = whole - k, k
                    for j in range(new, new + k):
                        start[sa[j]] = new
        end = g
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            s = start[j]
            out[free[s]] = j
            free[s] += 1
            j = prev[j]
    return out[1:]


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """lcp[k]: symbols that suffixes sa[k - 1] and sa[k] share."""
    n = len(text)
    rank, lcp, h = [0] * n, [0] * n, 0
    for k, i in enumerate(sa):
        rank[i] = k
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp
