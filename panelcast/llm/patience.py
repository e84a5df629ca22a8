"""Patience alignment of two word sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

Words = list[bytes]


def _longest_increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by their first member, whose second members increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(places):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(places[i])
        i = back[i]
    return chain[::-1]


def _common(a: Words, b: Words, la: int, ha: int, lb: int, hb: int) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps that no unique word divides."""
    rows = [[0] * (hb - lb + 1)]
    for i in range(la, ha):
        last, row = rows[-1], [0]
        for j in range(lb, hb):
            row.append(last[j - lb] + 1 if a[i] == b[j] else max(row[-1], last[j - lb + 1]))
        rows.append(row)
    i, j, out = ha, hb, []
    while i > la and j > lb:
        if a[i - 1] == b[j - 1] and rows[i - la][j - lb] == rows[i - la - 1][j - lb - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - la - 1][j - lb] >= rows[i - la][j - lb - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: Words, b: Words) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both.

    Anchors are words that occur once in each sequence, of which the longest increasing run is kept; the gaps
    between anchors are aligned in the same way.
    """
    out, pending = [], [(0, len(a), 0, len(b))]
    while pending:
        la, ha, lb, hb = pending.pop()
        while la < ha and lb < hb and a[la] == b[lb]:
            out.append((la, lb))
            la, lb = la + 1, lb + 1
        while la < ha and lb < hb and a[ha - 1] == b[hb - 1]:
            ha, hb = ha - 1, hb - 1
            out.append((ha, hb))
        if la == ha or lb == hb:
            continue
        in_a, in_b = Counter(a[la:ha]), Counter(b[lb:hb])
        once = {b[j]: j for j in range(lb, hb) if in_b[b[j]] == 1 and in_a[b[j]] == 1}
        anchors = _longest_increasing([(i, once[a[i]]) for i in range(la, ha) if a[i] in once])
        if not anchors:
            if in_a.keys() & in_b.keys():
                out += _common(a, b, la, ha, lb, hb)
            continue
        out += anchors
        for (i, j), (k, m) in zip([(la - 1, lb - 1), *anchors], [*anchors, (ha, hb)]):
            pending.append((i + 1, k, j + 1, m))
    return sorted(out)
