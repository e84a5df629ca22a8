"""Quality rules: plain statistics that fail a text, and a hashed n-gram logistic regression for the rest.

Words, word pairs and runs of three and of four characters (code points) are hashed into one table of weights;
the margin of a text is the mean weight of its word n-grams plus the mean weight of its character n-grams. Weights
are learned by iterative parameter mixing: labelled texts are dealt by hash into ``PARTS`` parts, in each epoch
mini-batch Adagrad goes over each part in a fixed order from the same start, and the driver averages what the parts
return. Parts and orders hang on ids and texts alone, so scores do not depend on how the tables are partitioned.
Margins of labelled texts that were kept aside give a calibrated probability, and texts are scored in Arrow batches
against a fixed threshold. N-grams are hashed piece by piece and never held for a whole text.

At most about ``MAX_LABELLED`` labelled texts are learned from, chosen by hash; every text is scored.

Defined results: null text has no words, lines or symbols and fails; labels are settled as in the rule
ensemble; without labels of both kinds, in either share, only the plain statistics decide; repeated rows are
judged once each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.lm import WordHashes, mixed
from panelcast.llm.rule_ensemble import one_label
from panelcast.llm.text import as_bytes, is_held_out, map_rows, small_batches, words
from panelcast.sources.stage import stage

MAX_LABELLED = 20_000
BITS = 18
CHARACTERS = (3, 4)
EPOCHS = 5
PARTS = 8
RATE = 0.5
MINI_BATCH = 32
#: Labelled rows whose remainder is this are kept for the calibration.
CALIBRATED = (5, 0)
KEEP_AT = 0.3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent

_SYMBOLS = b"#*$%&|<>"
_SPACE, _TAIL = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))
_SHIFT = np.uint64(64 - BITS)
_PIECE = 1 << 20
_BLANK = re.compile(rb"[ \t\n\v\f\r]")
#: Odd multipliers that tell the places of a run apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a window of three that occurs at least twice."""
    n = len(tokens)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    window = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = window[2][window[1]] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i:n - 2 + i] |= often
    return int(inside.sum())


def plain_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated windows."""
    tokens = words(text)
    if not tokens:
        return 0, 0, len(text) - len(text.translate(None, _SYMBOLS)) if text else 0, 0, 0
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return (len(tokens), len(text.translate(None, _SPACE + _TAIL)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(tokens))


def fails(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def characters(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 begins, and its bytes as one number."""
    inner = (octets & 0xC0) == 0x80
    if not inner.any():
        return np.arange(len(octets)), octets.astype(np.uint64)
    start = np.flatnonzero(~inner)
    value, going = octets[start].astype(np.uint64), np.ones(len(start), bool)
    octets, inner = np.append(octets, np.zeros(3, np.uint8)), np.append(inner, np.zeros(3, bool))
    for k in (1, 2, 3):
        going &= inner[start + k]
        value = np.where(going, (value << np.uint64(8)) | octets[start + k], value)
    return start, value


class Hasher:
    """Buckets of the n-grams of many texts at once, with the text that each belongs to, piece by piece."""

    def __init__(self) -> None:
        self.known = WordHashes()

    def _hashes(self, tokens: list[bytes]) -> list[int]:
        if len(self.known) > 300_000:
            self.known.clear()
        return list(map(self.known.__getitem__, tokens))

    @staticmethod
    def _pieces(text: bytes | None) -> Iterator[bytes]:
        """The text, cut at white space; a longer word stays whole."""
        start, n = 0, len(text or b"")
        while start < n:
            blank = _BLANK.search(text, start + _PIECE) if n - start > _PIECE else None
            end = blank.start() if blank else n
            yield text[start:end]
            start = end

    def word_grams(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words, and pairs of words within each text."""
        out, owners, size = [], [], 0
        for i, text in enumerate(texts):
            last: list[int] = []  # the word before the piece, for the pair across
            for piece in self._pieces(text):
                hashes = self._hashes(piece.lower().split())
                if size + len(piece) > _PIECE and out:
                    yield self._words(out, owners)
                    out, owners, size = [], [], 0
                out.append((last, hashes))
                owners.append(i)
                size += len(piece)
                last = hashes[-1:] or last
        if out:
            yield self._words(out, owners)

    @staticmethod
    def _words(out: list[tuple[list[int], list[int]]], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        one = np.fromiter(chain.from_iterable(hashes for _, hashes in out), np.uint64)
        owner = np.repeat(owners, [len(hashes) for _, hashes in out])
        row = np.fromiter(chain.from_iterable(chain(last, hashes) for last, hashes in out), np.uint64)
        at = np.repeat(np.arange(len(out)), [len(last) + len(hashes) for last, hashes in out])
        same = at[1:] == at[:-1]
        pair = mixed(mixed(row[:-1]) + row[1:])[same]
        buckets = np.concatenate([mixed(one), pair]) >> _SHIFT
        return buckets.astype(np.int64), np.concatenate([owner, np.asarray(owners, np.int64)[at[1:][same]]])

    def character_grams(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of three and of four characters within each text."""
        texts = [t or b"" for t in texts]
        octets = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        held, held_owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        start = 0
        while start < len(octets):
            end = min(len(octets), start + _PIECE)
            while end < len(octets) and octets[end] & 0xC0 == 0x80:
                end += 1
            place, value = characters(octets[start:end])
            before = np.searchsorted(place, ends - start)  # characters before the end of each text
            owner = np.repeat(np.arange(len(texts)), np.diff(before, prepend=0))
            value, owner = np.concatenate([held, value]), np.concatenate([held_owner, owner])
            for run in CHARACTERS:
                n, skip = len(value) - run + 1, max(0, len(held) - run + 1)  # runs within ``held`` were counted before
                if n > skip:
                    code = sum(value[skip + i:n + i] * _PLACES[i] for i in range(run))
                    own = owner[skip:n]
                    same = owner[skip + run - 1:n + run - 1] == own
                    yield (mixed(code[same] + np.uint64(run)) >> _SHIFT).astype(np.int64), own[same]
            keep = max(CHARACTERS) - 1
            held, held_owner, start = value[-keep:], owner[-keep:], end


def margins(weights: np.ndarray, bias: float, texts: list[bytes | None], hasher: Hasher) -> tuple[np.ndarray, list[np.ndarray]]:
    """Margin of each text, and how many n-grams of either kind it has (one where it has none)."""
    total, sizes = np.full(len(texts), bias), []
    for kind in (hasher.word_grams, hasher.character_grams):
        weight, size = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owner in kind(texts):
            weight += np.bincount(owner, weights[buckets], minlength=len(texts))
            size += np.bincount(owner, minlength=len(texts))
        sizes.append(np.maximum(1, size))
        total = total + weight / sizes[-1]
    return total, sizes


def gradient(error: np.ndarray, texts: list[bytes | None], sizes: list[np.ndarray], hasher: Hasher) -> np.ndarray:
    """Slope of the loss by weight, given its slope by margin; hashes the texts once more instead of keeping n-grams."""
    step = np.zeros(1 << BITS)
    for kind, size in zip((hasher.word_grams, hasher.character_grams), sizes):
        for buckets, owner in kind(texts):
            step += np.bincount(buckets, (error / size)[owner], minlength=len(step))
    return step


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Learner:
    """One pass of mini-batch Adagrad over the texts it is given in turn."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.copy(), bias
        self._seen, self._bias_seen = np.full(len(weights), 1e-8), 1e-8
        self._texts: list[bytes] = []
        self._labels: list[float] = []
        self.n, self._hasher = 0, Hasher()

    def add(self, text: bytes, label: float) -> None:
        self._texts.append(text)
        self._labels.append(label)
        if len(self._texts) == MINI_BATCH:
            self.step()

    def step(self) -> None:
        if not self._texts:
            return
        margin, sizes = margins(self.weights, self.bias, self._texts, self._hasher)
        error = (logistic(margin) - np.array(self._labels)) / len(self._texts)
        step = gradient(error, self._texts, sizes, self._hasher)
        self._seen += step * step
        self.weights -= RATE * step / np.sqrt(self._seen)
        self._bias_seen += error.sum() ** 2
        self.bias -= RATE * error.sum() / np.sqrt(self._bias_seen)
        self.n += len(self._texts)
        self._texts, self._labels = [], []


@dataclass(frozen=True)
class NgramModel:
    """Weights by bucket; probability is the logistic of ``slope`` times the margin plus ``offset``."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, texts: list[bytes | None], hasher: Hasher) -> np.ndarray:
        margin, _ = margins(self.weights, self.bias, texts, hasher)
        return logistic(self.slope * margin + self.offset)


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that fits the labels best, with labels drawn in a little at both ends."""
    ones, zeros = label.sum(), len(label) - label.sum()
    goal = np.where(label > 0.5, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    theta = np.array([1.0, 0.0])

    def loss(t):
        z = x @ t
        return float((np.logaddexp(0, z) - goal * z).sum())

    for _ in range(50):
        p = logistic(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> NgramModel | None:
    """The model, or None where labels of both kinds are missing in either share."""
    spark = docs.sparkSession
    chosen = F.broadcast(one_label(labels, most))  # about ``most`` rows of two numbers
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    sample = sample.withColumns({"aside": is_held_out(*CALIBRATED), "place": order, "part": F.pmod(order, F.lit(PARTS))})
    sample = stage(sample.select("text", "label", "aside", "place", "part"), "labelled_texts")
    kinds = {(r["aside"], r["label"]) for r in sample.select("aside", "label").distinct().collect()}
    if len(kinds) < 4:
        return None
    weights, bias = np.zeros(1 << BITS), 0.0
    learned = sample.where("not aside").drop("aside").repartitionByRange(PARTS, "part").sortWithinPartitions(
        "part", "place", "text", "label")
    for _ in range(EPOCHS):
        start = spark.sparkContext.broadcast((weights, bias))

        def train(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            learner, at = None, None

            def done() -> pa.RecordBatch:
                learner.step()
                values = [[at], [learner.n], [float(learner.bias)], [learner.weights.astype(np.float32).tobytes()]]
                return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["part", "n", "b", "w"])

            for batch in small_batches(batches):
                rows = zip(as_bytes(batch.column("text")), batch.column("label").to_pylist(), batch.column("part").to_pylist())
                for text, label, part in rows:
                    if part != at:
                        if learner:
                            yield done()
                        learner, at = Learner(*start.value), part
                    learner.add(text, label)
            if learner:
                yield done()

        found = learned.mapInArrow(train, "part bigint, n bigint, b double, w binary").collect()  # PARTS rows at most
        found.sort(key=lambda r: r["part"])
        total = sum(r["n"] for r in found)
        weights = sum(np.frombuffer(r["w"], np.float32).astype(float) * (r["n"] / total) for r in found)
        bias = sum(r["b"] * r["n"] for r in found) / total
        start.destroy()
    start = spark.sparkContext.broadcast((weights, bias))
    hasher = Hasher()

    def measured(batch: pa.RecordBatch) -> list:
        return [margins(*start.value, as_bytes(batch.column("text")), hasher)[0]]

    aside = map_rows(sample.where("aside").select("text", "label", "place"), measured, "margin double")
    pairs = aside.select("margin", "label", "place").toArrow().sort_by([(c, "ascending") for c in ("place", "margin", "label")])
    slope, offset = calibrate(pairs["margin"].to_numpy(), pairs["label"].to_numpy())
    return NgramModel(weights.astype(np.float32), bias, slope, offset)


def judge(docs: DataFrame, model: NgramModel | None, keep_at: float = KEEP_AT) -> DataFrame:
    """Add the plain statistics, ``base_failed``, ``score`` and ``kept`` to documents with a ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hasher = Hasher()

    def of_batch(batch: pa.RecordBatch) -> list:
        texts = as_bytes(batch.column("text"))
        plain = [plain_statistics(t) for t in texts]
        failed = [fails(p[0], p[4]) for p in plain]
        if shared.value is None:
            score, good = [None] * len(texts), [True] * len(texts)
        else:
            score = shared.value.probabilities(texts, hasher)
            good = (score >= keep_at).tolist()
        return [*map(list, zip(*plain)), failed, score, [g and not f for g, f in zip(good, failed)]]

    return map_rows(docs, of_batch, (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, score double, kept boolean"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
