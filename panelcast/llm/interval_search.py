"""Best-first search of document intervals over posting lists with range-maximum sparse tables.

A segment holds the postings of a run of documents: for each term the documents that hold it, in order, each
with its impact, the term's share of a document's score. A sparse table over the lists answers where the largest impact
of any range of a list is. For a set of terms the sum of these maxima over an interval of documents bounds the score
of each document inside, so the search takes the intervals of the highest bounds first, splits each at the
document of its largest single impact, scores that document, and bounds what is left on both sides anew. It ends
when no interval can hold a document among the best.

Intervals are taken ``BATCH`` at a time, so the work of one step is array operations. Taking more than the first at once scores
documents that strict order might have spared, and changes no result.
"""

from __future__ import annotations

import numpy as np

BATCH = 64


class Best:
    """The best documents so far: highest score first, of equal ones the smallest key."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.scores, self.keys = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        first = np.lexsort((keys, -scores))[:self.size]
        self.scores, self.keys = scores[first], keys[first]

    def beaten(self, bounds: np.ndarray, least_keys: np.ndarray) -> np.ndarray:
        """Where nothing of at most these scores and at least these keys can get in."""
        if len(self.scores) < self.size:
            return bounds <= 0
        worst, key = self.scores[-1], self.keys[-1]
        return (bounds < worst) | (bounds == worst) & (least_keys > key) | (bounds <= 0)


class Segment:
    """Postings of documents 0 to ``n_docs`` - 1, whose ``keys`` (ascending) name them in results."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        n = self.n_docs = len(keys)
        self.keys = keys
        order = np.lexsort((docs, terms))
        self.docs, self.impacts = docs[order].astype(np.int64), impacts[order].astype(np.int64)
        self.terms, first = np.unique(terms[order], return_index=True)
        self.starts = np.append(first, len(order)).astype(np.int64)
        numbers = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        self.places = numbers * n + self.docs  # ascending over all lists
        longest = int(np.diff(self.starts).max(initial=0))
        # level j: where the largest impact of the 2^j postings from each one on is; only ranges inside a list are asked
        self.table = np.zeros((max(longest, 1).bit_length(), len(order)), np.int32)
        self.table[0] = np.arange(len(order))
        for j in range(1, len(self.table)):
            half, size = 1 << (j - 1), 1 << j
            left, right = self.table[j - 1, :len(order) - size + 1], self.table[j - 1, half:len(order) - half + 1]
            self.table[j, :len(left)] = np.where(self.impacts[left] >= self.impacts[right], left, right)
        self.levels = np.floor(np.log2(np.maximum(np.arange(longest + 1), 1))).astype(np.int64)

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of each range of postings, 0 if it is empty, and where it is."""
        some = high > low
        level = self.levels[high - low]
        left = self.table[level, np.where(some, low, 0)]
        right = self.table[level, np.where(some, high - (1 << level), 0)]
        a, b = self.impacts[left], self.impacts[right]
        return np.where(some, np.maximum(a, b), 0), np.where(a >= b, left, right)

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Let the documents' scores for the terms enter ``best``; returns how many were scored."""
        own = np.flatnonzero(np.isin(self.terms, terms))
        if not len(own):
            return 0
        base = own * self.n_docs
        low, high = self.starts[own][None, :], self.starts[own + 1][None, :]
        from_, to = np.zeros(1, np.int64), np.full(1, self.n_docs)
        most, where = self.largest(low, high)
        bounds, scored = most.sum(axis=1), 0
        while len(bounds):
            if len(bounds) > BATCH:
                order = np.argpartition(-bounds, BATCH)
                now, later = order[:BATCH], order[BATCH:]
            else:
                now, later = np.arange(len(bounds)), np.empty(0, np.int64)
            rows = np.arange(len(now))
            split = self.docs[where[now][rows, most[now].argmax(axis=1)]]
            at = np.searchsorted(self.places, (base + split[:, None]).ravel()).reshape(len(now), -1)
            at = np.minimum(np.maximum(at, low[now]), high[now])
            held = at < high[now]
            held &= self.docs[np.where(held, at, 0)] == split[:, None]
            best.add(np.where(held, self.impacts[np.where(held, at, 0)], 0).sum(axis=1), self.keys[split])
            scored += len(now)
            new_low, new_high = np.concatenate([low[now], at + held]), np.concatenate([at, high[now]])
            new_from, new_to = np.concatenate([from_[now], split + 1]), np.concatenate([split, to[now]])
            new_most, new_where = self.largest(new_low, new_high)
            new = (new_low, new_high, new_from, new_to, new_most, new_where, new_most.sum(axis=1))
            old = (low, high, from_, to, most, where, bounds)
            low, high, from_, to, most, where, bounds = (
                np.concatenate([x[later], y]) for x, y in zip(old, new))
            left = ~best.beaten(bounds, self.keys[np.minimum(from_, self.n_docs - 1)])
            low, high, from_, to, most, where, bounds = (
                x[left] for x in (low, high, from_, to, most, where, bounds))
        return scored
