"""Word alignment of two texts: a small helper that Arrow batches call row by row.

Equal ends go first.  Words that occur once on both sides *and* have an equal
neighbour there anchor the rest; of those the longest chain that rises on both
sides is kept, and every stretch between two anchors is aligned again by itself,
with the words that are unique inside it.  A stretch without anchors is aligned
by edit distance (match before swap before gap).
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np

#: Cells of a distance table held at once; larger stretches are halved first.
CELLS = 1 << 22
#: Cells of a stretch that is aligned by edit distance at once.
SMALL = 64


def matches(a: Sequence[int], b: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of the words aligned as equal, rising in both."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            yield n, m
        if i == n or j == m or n - i == m - j == 1:
            continue
        if (n - i) * (m - j) <= SMALL:
            yield from _small(a, b, i, n, j, m)
            continue
        chain = _rising(_anchors(a, b, i, n, j, m))
        if not chain:
            yield from _by_distance(a, b, i, n, j, m)
            continue
        for x, y in chain:
            yield x, y
            if i < x and j < y:
                todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        todo.append((i, n, j, m))


def swaps(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of one-to-one substitutions: runs between matches that are equally long on both sides."""
    out, i, j = [], 0, 0
    for x, y in [*sorted(matches(a, b)), (len(a), len(b))]:
        if x - i == y - j:
            out += [(i + k, j + k) for k in range(x - i)]
        i, j = x + 1, y + 1
    return out


def _anchors(a, b, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    def once(words, start, end):
        at: dict[int, int] = {}
        for k in range(start, end):
            at[words[k]] = -1 if words[k] in at else k
        return at

    left, right = once(a, i, n), once(b, j, m)
    out = []
    for word, x in left.items():
        y = right.get(word, -1)
        if x >= 0 and y >= 0 and (x > i and y > j and a[x - 1] == b[y - 1] or x + 1 < n and y + 1 < m and a[x + 1] == b[y + 1]):
            out.append((x, y))
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with rising second places (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _rows(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the edit distance table; gaps along a row come from a running minimum."""
    at = np.arange(len(b) + 1)
    row = at.copy()
    yield row
    for word in a:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (b != word))
        row = np.minimum.accumulate(step - at) + at
        yield row


def _back(table, same, k: int, c: int) -> Iterator[tuple[int, int]]:
    """Matches of the cheapest way through a table of edit distances, from its end; a swap comes before a gap."""
    while k and c:
        here, equal = table[k][c], same(k - 1, c - 1)
        if here == table[k - 1][c - 1] + (not equal):
            k, c = k - 1, c - 1
            if equal:
                yield k, c
        elif here == table[k - 1][c] + 1:
            k -= 1
        else:
            c -= 1


def _small(a, b, i: int, n: int, j: int, m: int) -> Iterator[tuple[int, int]]:
    row = list(range(m - j + 1))
    table = [row]
    for x in range(i, n):
        new, word = [x - i + 1], a[x]
        for y in range(m - j):
            new.append(min(row[y + 1] + 1, new[y] + 1, row[y] + (word != b[j + y])))
        table.append(new)
        row = new
    for k, c in _back(table, lambda k, c: a[i + k] == b[j + c], n - i, m - j):
        yield i + k, j + c


def _by_distance(a, b, i: int, n: int, j: int, m: int) -> Iterator[tuple[int, int]]:
    x, y = np.asarray(a[i:n]), np.asarray(b[j:m])
    if len(x) == 1 or len(y) == 1:  # the ends differ, so one word meets at most one equal one inside
        k = np.flatnonzero(x == y[0]) if len(y) == 1 else np.flatnonzero(y == x[0])
        if len(k):
            yield (i + int(k[0]), j) if len(y) == 1 else (i, j + int(k[0]))
        return
    if len(x) * len(y) > CELLS:
        half = len(x) // 2
        for head in _rows(x[:half], y):
            pass
        for tail in _rows(x[half:][::-1], y[::-1]):
            pass
        cost = head + tail[::-1]
        best = np.flatnonzero(cost == cost.min())
        cut = int(best[np.argmin(np.abs(best - half))])
        for i1, n1, j1, m1 in ((i, i + half, j, j + cut), (i + half, n, j + cut, m)):
            if i1 < n1 and j1 < m1:
                yield from _by_distance(a, b, i1, n1, j1, m1)
        return
    for k, c in _back(list(_rows(x, y)), lambda k, c: x[k] == y[c], len(x), len(y)):
        yield i + k, j + c
