"""Suffix arrays by linear grouping, after Baier (CPM 2016), and their common prefixes.

Suffixes are grouped by their first symbol. Groups are taken from the highest
down; for every suffix of the group the nearest earlier suffix of a lower group is
found along the pointers of those already known (previous-smaller pointers). The
suffixes pointed at leave their groups and form new ones right above them, higher
the more pointers they have, so that at the end each group holds the suffixes that
start with one and the same Lyndon word. A second pass emits the order: behind
each suffix that is already in place, the one before it takes the next place of
its group, and so do its previous-smaller suffixes. Nothing is renamed and there
is no recursion.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol must be its single least one;
    linear in the text and its largest symbol."""
    n = len(text)
    if n <= 1:
        return list(range(n))
    buckets: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for s in range(n):
        buckets[text[s]].append(s)
    order = [s for bucket in buckets for s in bucket]
    place = [0] * n  # where a suffix lies in order
    start = [0] * n  # first place of a suffix's group
    end = [0] * (n + 1)  # by first place: past the group's last place
    first = 0
    for at, s in enumerate(order):
        place[s] = at
        if at and text[s] != text[order[at - 1]]:
            end[first] = at
            first = at
        start[s] = first
    end[first] = n
    before: list[int | None] = [None] * n  # previous-smaller pointers
    high = n
    while high > 0:
        low = start[order[high - 1]]
        pointed: dict[int, int] = {}
        for s in order[low:high]:
            if before[s] is not None:
                continue  # found on the way from a later one of its group
            path, j = [s], s - 1
            while j >= 0 and start[j] >= low:
                if before[j] is None:  # of the same group: the same pointer
                    path.append(j)
                    j -= 1
                else:
                    j = before[j]
            for k in path:
                before[k] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + len(path)
        if pointed:
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}  # by old group: places taken at its end
                subset = by_count[c]
                for j in subset:
                    g = start[j]
                    taken = moved[g] = moved.get(g, 0) + 1
                    to, at = end[g] - taken, place[j]
                    other = order[to]
                    order[to], order[at] = j, other
                    place[j], place[other] = to, at
                fresh = {}
                for g, taken in moved.items():
                    top = end[g] - taken
                    if top > g:
                        end[top] = end[g]
                        end[g] = top
                        fresh[g] = top
                for j in subset:
                    if start[j] in fresh and place[j] >= fresh[start[j]]:
                        start[j] = fresh[start[j]]
        high = low
    out = [0] * n
    seated = [False] * n
    free = list(range(n))  # by first place of a group: its next free place
    out[0], seated[n - 1] = n - 1, True
    free[start[n - 1]] += 1
    for r in range(n):
        s = out[r] - 1
        while s >= 0 and not seated[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            seated[s] = True
            s = before[s]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """lcp[r]: symbols that the suffixes at places r - 1 and r share."""
    n = len(text)
    place = [0] * n
    for r, s in enumerate(order):
        place[s] = r
    lcp, k = [0] * n, 0
    for s in range(n):
        r = place[s]
        if r == 0:
            k = 0
            continue
        other = order[r - 1]
        while s + k < n and other + k < n and text[s + k] == text[other + k]:
            k += 1
        lcp[r] = k
        if k:
            k -= 1
    return lcp
