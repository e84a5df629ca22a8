"""Token counts of every prefix of a text under a byte-level BPE vocabulary, by dynamic programming.

The encoding of a piece's prefix ends in exactly one token. It is the token whose left neighbour, the last
token of the prefix before it, keeps apart from it when both are encoded side by side. So one walk over a
piece finds the last token and the count of every prefix from those of shorter prefixes, and nothing is
encoded twice.

Text is split into pieces first. Cutting a text changes only its last piece or two: a cut inside a run of
white space makes all of the run one piece, and a cut contraction is an apostrophe and a letter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import ahocorasick
import regex
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

#: Bounds of what a worker remembers: pieces and pairs of tokens, each in two generations of this many.
REMEMBERED = 1 << 18
#: Longer pieces, in bytes, are counted anew each time.
LONGEST_REMEMBERED = 64

_SPLIT = regex.compile(PATTERN)
#: The same over ASCII text, which the standard module splits faster.
_SPLIT_ASCII = re.compile(
    PATTERN.replace(r"\p{L}\p{N}", "A-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)
_SPACE = regex.compile(r"\s+")
_NEVER = 1 << 60
_SHIFT = 32


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of the vocabulary file stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Remembered(dict):
    """A dictionary of bounded size that forgets what was not asked for lately."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def recall(self, key):
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value


class PrefixCounter:
    """Counts of one vocabulary: the text of a tokenizer file of byte-level BPE without a normalizer."""

    def __init__(self, file: str) -> None:
        read = json.loads(file)
        model, before = read["model"], read["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"]
        if not plain or before["add_prefix_space"] or read["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        symbols = byte_of_symbol()

        def as_bytes(token: str) -> bytes:
            return bytes(symbols[c] for c in token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in read["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.library = Tokenizer.from_str(file).pre_tokenizer
        self.edges: list[tuple[list, list]] = []
        self.endings = ahocorasick.Automaton()
        for token in dict.fromkeys([*(bytes([b]) for b in range(256)), *(a + b for a, b in self.ranks)]):
            parts = self.merged(token)
            if len(parts) == 1:  # others can never be the token of their own bytes
                _, left, right = parts[0]
                self.endings.add_word(token.decode("latin-1"), (len(self.edges), len(token)))
                self.edges.append(([*left, (token, _NEVER)], [*right, (token, _NEVER)]))
        self.endings.make_automaton()
        self.pieces, self.pairs = Remembered(), Remembered()

    # vocabulary

    def merged(self, text: bytes) -> list[tuple[bytes, list, list]]:
        """The encoding by the merges themselves: each token with its left and its right edge.

        An edge lists the parts that were outermost one after another, each with the rank that took it up.
        """
        parts = [(text[i:i + 1], [], []) for i in range(len(text))]
        while len(parts) > 1:
            ranked = [self.ranks.get((a[0], b[0]), _NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(ranked)
            if rank == _NEVER:
                break
            k = ranked.index(rank)
            (a, left, _), (b, _, right) = parts[k], parts[k + 1]
            parts[k:k + 2] = [(a + b, [*left, (a, rank)], [*right, (b, rank)])]
        return parts

    def keeps_apart(self, pair: int) -> bool:
        """Whether two tokens, side by side, stay as they are: no merge across them comes before their own."""
        known = self.pairs.recall(pair)
        if known is None:
            right, left = self.edges[pair >> _SHIFT][1], self.edges[pair & (1 << _SHIFT) - 1][0]
            known = True
            for x, taken_x in right:
                for y, taken_y in left:
                    rank = self.ranks.get((x, y))
                    # of equal merges the one further left comes first
                    if rank is not None and rank < taken_x and rank <= taken_y:
                        known = False
            self.pairs.keep(pair, known)
        return known

    # pieces

    def walk(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of the piece, from no byte to all."""
        counts, last = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        known, done = self.pairs.get, 0
        for at, (token, size) in self.endings.iter(piece.decode("latin-1")):  # longest first at each place
            end = at + 1
            if end == done:
                continue
            start = end - size
            if start:
                pair = last[start] << _SHIFT | token
                apart = known(pair)
                if not (self.keeps_apart(pair) if apart is None else apart):
                    continue
            counts[end], last[end], done = counts[start] + 1, token, end
        return counts

    def of_piece(self, piece: str) -> Sequence[int]:
        """Tokens of each prefix of the piece by code points, from none to all."""
        known = self.pieces.recall(piece)
        if known is None:
            coded = piece.encode()
            known = self.walk(coded)
            if len(coded) > len(piece):
                known = [0, *(known[e] for e in accumulate(len(c.encode()) for c in piece))]
            if len(coded) <= LONGEST_REMEMBERED:
                known = bytes(known)
                self.pieces.keep(piece, known)
        return known

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT_ASCII.findall(text)
        # characters that Python's own tables do not know may be of another class in the library's
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    # texts

    def _segments(self, text: str) -> list[tuple[str, bool]]:
        """The text in order, cut at special strings, and whether each part is one."""
        if self.special is None or not self.special.search(text):
            return [(text, False)]
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [(text[at:m.start()], False), (m.group(), True)]
            at = m.end()
        return [*parts, (text[at:], False)]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        known, total = self.pieces.get, 0
        for part, special in self._segments(text or ""):
            total += 1 if special else sum([(known(p) or self.of_piece(p))[-1] for p in self.split(part)])
        return total

    def prefix_counts(self, text: str | None) -> list[int]:
        """Entry i is the number of tokens of the first i code points, as the library gives it for that text alone."""
        counts: list[int] = [0]
        for part, special in self._segments(text or ""):
            if special:
                counts += [*self._before_special(text, len(counts) - 1, len(part)), counts[-1] + 1]
            else:
                counts += self._of_part(part, counts[-1])
        return counts

    def _of_part(self, part: str, base: int) -> list[int]:
        counts: list[int] = []
        run, run_base = "", base  # white space that directly precedes, and the count before it
        for piece in self.split(part):
            own = self.of_piece(piece)
            added = [base + n for n in own[1:]]
            if _SPACE.fullmatch(piece):
                if run:
                    run += piece
                    added = [run_base + n for n in self.of_piece(run)[-len(piece):]]
                else:
                    run, run_base = piece, base
            else:
                if piece[0] == " " and run:
                    added[0] = run_base + self.of_piece(run + piece[0])[-1]
                elif piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                    added[1] = base + 2
                run = ""
            counts += added
            base += own[-1]
        return counts

    def _before_special(self, text: str, start: int, size: int) -> list[int]:
        """Counts of the prefixes that end inside a special string, which is ordinary text until it is whole."""
        return [self.count(text[:start + n]) for n in range(1, size)]


def longest_prefix(counts: list[int], budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    last = bisect_right(list(accumulate(reversed(counts), min))[::-1], budget) - 1
    return max(last, 0)
