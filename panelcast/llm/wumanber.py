"""Wu-Manber search for many patterns at once, over sequences of words.

The last ``block`` words of the current position give a shift: how far the next possible end of any
pattern is. A shift of zero gives a bucket of patterns that end in that block, and each is compared
word by word.
"""

from __future__ import annotations

BLOCK = 2


class WuManber:
    """Patterns of one length; a block is two words, or one for patterns of one word."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[int, ...]], length: int) -> None:
        self.length = length
        self.block = min(BLOCK, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict[object, list[tuple[tuple[bytes, ...], tuple[int, ...]]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.furthest), length - end)
            self.buckets.setdefault(self._key(pattern, length), []).append((pattern, owners))

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> list[tuple[int, tuple[int, ...]]]:
        """Start of every occurrence, with the owners of the pattern."""
        found, end, n = [], self.length, len(words)
        shift, furthest, pair = self.shift.get, self.furthest, self.block == 2
        while end <= n:
            key = (words[end - 2], words[end - 1]) if pair else words[end - 1]
            step = shift(key, furthest)
            if step == 0:
                start = end - self.length
                here = tuple(words[start:end])
                for pattern, owners in self.buckets[key]:
                    if pattern == here:
                        found.append((start, owners))
                step = 1
            end += step
        return found
