"""Language identification by rank-order n-gram profiles.

A profile is the list of a text's (or language's) most frequent letter n-grams in order of count.
A document gets the language whose profile has the least out-of-place distance: the sum, over the
document's own profile, of how far each n-gram's rank is from its rank in the language, where an
n-gram that the language lacks costs a whole profile.

Letters are the characters of Unicode's category L; combining marks belong to the letter before them.

Defined results: null text and text without a letter are ``und`` with score 0, as is every text when
nothing was learned; distances that tie give the first language by code point; n-grams with equal
counts rank by code points; repeated rows are predicted (and counted) once each; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.text import filter_rows, is_held_out, is_learned, map_rows, small_batches

UNKNOWN = "und"
PROFILE_SIZE = 400
HELD_OUT = (3, 1)
#: A confident text scores above 0.3; unrelated letters stay near 0.
REJECT_BELOW = 0.05

#: Between words: whatever is no letter. Other numerals count as word characters here, and marks as gaps.
_GAP = re.compile(r"[\W\d_]+")
#: The same for texts that have such numerals or marks: a mark belongs to the letter that it follows.
_WIDE_GAP = regex.compile(r"(?:[^\p{L}\p{M}]\p{M}*|\A\p{M}+)+")
_WIDE = frozenset(("No", "Nl", "Mn", "Mc", "Me"))
_EDGE = ord("_")
_FLUSH = 200_000
_PIECE = 1 << 20


def gap_of(text: str):
    """The pattern that parts the words of a text in lower case."""
    if text.isascii() or not any(unicodedata.category(c) in _WIDE for c in set(text)):
        return _GAP
    return _WIDE_GAP


def grams(text: str) -> np.ndarray:
    """Codes of all letter n-grams of one to three code points, 21 bits a code point; words are edged with ``_``."""
    text = text.lower()
    letters = gap_of(text).sub("_", text).strip("_")
    if not letters:
        return np.empty(0, np.int64)
    u = np.frombuffer(f"_{letters}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (u[:-1] << 21) | u[1:]
    three = (two[:-1] << 21) | u[2:]
    return np.concatenate([u[u != _EDGE], two, three[u[1:-1] != _EDGE]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and their counts; a very long text is counted piece by piece."""
    if len(text) <= _PIECE:
        return np.unique(grams(text), return_counts=True)
    total: Counter = Counter()
    cuts, start, between = [], 0, gap_of(text)
    while start < len(text):  # cut between words where there is a gap
        end = start + _PIECE
        gap = between.search(text, end) if end < len(text) else None
        end = gap.end() if gap else len(text)
        cuts.append((start, end))
        start = end
    for a, b in cuts:
        codes, n = np.unique(grams(text[a:b]), return_counts=True)
        total.update(dict(zip(codes.tolist(), n.tolist())))
    codes = np.array(sorted(total), np.int64)
    return codes, np.array([total[c] for c in codes.tolist()], np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """``rank[l, i]`` is the rank in language ``l`` of ``codes[i]``, or ``size`` if it is not in its profile."""

    languages: tuple[str, ...]
    codes: np.ndarray
    rank: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From rows of language, code and rank."""
        languages = tuple(sorted({r[0] for r in rows}))
        codes = np.array(sorted({r[1] for r in rows}), np.int64)
        rank = np.full((len(languages), len(codes)), size, np.int64)
        if rows:
            where = np.searchsorted(codes, np.array([r[1] for r in rows], np.int64))
            index = {name: i for i, name in enumerate(languages)}
            rank[[index[r[0]] for r in rows], where] = [r[2] for r in rows]
        return cls(languages, codes, rank, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and 1 less the share of the largest possible distance."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        codes, counts = counted(text)
        if not len(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        place = np.where(known, self.rank[:, at], self.size)
        away = np.where(place == self.size, self.size, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(own))


def gram_counts(docs: DataFrame) -> DataFrame:
    """Counts by ``lang`` and code over all rows; each task sums before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, c, n) for lang, counter in sums.items() for c, n in counter.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], ["lang", "code", "n"])

        for batch in small_batches(batches, 2 << 20):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, its in zip(texts, langs) if its == lang]
                short = [grams(t) for t in own if len(t) <= _PIECE]
                found = [np.unique(np.concatenate(short), return_counts=True)] if short else []
                for codes, n in [*found, *(counted(t) for t in own if len(t) > _PIECE)]:
                    sums.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), n.tolist())))
            if sum(map(len, sums.values())) > _FLUSH:
                yield flush()
        yield flush()

    known = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.mapInArrow(run, "lang string, code bigint, n bigint")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every language in ``lang``. The driver gets ``size`` rows per language, after each task has cut."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = gram_counts(docs).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles.of([(r["lang"], r["code"], r["rank"]) for r in top.collect()], size)


def predictor(spark, profiles: Profiles):
    shared = spark.sparkContext.broadcast(profiles)

    def predict(batch: pa.RecordBatch) -> list[tuple[str, float]]:
        return [shared.value.predict(t) for t in batch.column("text").to_pylist()]

    return predict


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    of_batch = predictor(docs.sparkSession, profiles)
    return map_rows(docs, lambda b: list(map(list, zip(*of_batch(b)))), "lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = REJECT_BELOW) -> DataFrame:
    """The documents, all columns, whose language is known with a score of at least ``least``."""
    of_batch = predictor(docs.sparkSession, profiles)
    return filter_rows(docs, lambda b: [lang != UNKNOWN and score >= least for lang, score in of_batch(b)])


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.where(is_learned(*HELD_OUT)).select("text", "lang")


def query(docs: DataFrame) -> DataFrame:
    profiles = fit(learned_rows(docs))
    rows = docs.select("doc_id", is_held_out(*HELD_OUT).alias("held_out"), "text")
    return predict(rows, profiles).drop("text")
