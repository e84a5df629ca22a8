"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised counts of all words and word pairs of the training texts: an n-gram of level
``q`` is entered as ``(n-gram, 1) .. (n-gram, q)``, and a count is read back by probing levels until one is
absent. Counts are gathered over the whole corpus. Every task sums its word pairs into sorted arrays of
64-bit hashes before the shuffle, so a frequent pair leaves each task once.

The filter is cut into segments by hash, each as long as its own entries need, and segments are built in
parallel. They are packed into shards of at most ``SHARD_BYTES``: one shard is broadcast at a time, and each
shard is one pass over the texts that fills in the counts it holds. The size of a broadcast therefore does not
grow with the corpus, the number of passes does.

Probabilities are those of a bigram model with Dirichlet smoothing towards the words' own frequencies. Next
to them comes the exact unigram score. Its counts are broadcast for at most ``HEAD_WORDS`` most frequent
words of at most ``HEAD_BYTES`` bytes each; the other words of a document are joined with the count table.

``least_count`` leaves rarer n-grams out of the filter (they are then probed like unseen ones), which bounds the passes where the
distinct n-grams of a corpus are mostly rare. By default, 1, the filter holds all.

Defined results: null and blank text is one end token; a row without ``doc_id`` is neither held out nor
learned from; repeated rows are counted and scored once each; without training texts every probability is
that of one unseen token, 1, and its logarithm 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelcast.llm.text import as_bytes, is_held_out, is_learned, map_rows, small_batches
from panelcast.sources.stage import stage

HELD_OUT = (5, 1)
END = ""  # no word is empty
HEAD_WORDS = 200_000
HEAD_BYTES = 64
SHARD_BYTES = 128 << 20
SEGMENT_TOKENS = 1 << 20
#: Bits per entry and probes per level; together about 3 % of absent levels are taken for present.
BITS_PER_ENTRY = 8
PROBES = 3
#: Counts are kept to the nearest power of this.
LOG_BASE = 1.5
#: How many observations the words' own frequencies are worth after any word.
SMOOTHING = 200.0
_FLUSH_WORDS = 300_000
_CHUNK_TOKENS = 1 << 21
#: Segments that leave a task in one Arrow batch, and that one task builds on average at most.
_FLUSH_SEGMENTS = 16
_TASK_SEGMENTS = 4
_TOP_LEVEL = 1 + int(math.log(2**63, LOG_BASE))

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of the text, A-Z in lower case; the end is not among them."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxh64_intdigest(word)
        return value


def hashed(texts: list[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text followed by its end, and where each text begins (one more at the end)."""
    if len(known) > _FLUSH_WORDS:
        known.clear()
    out, bounds = [], [0]
    end = END.encode()
    for text in texts:
        out.extend(map(known.__getitem__, tokens(text)))
        out.append(known[end])
        bounds.append(len(out))
    return np.array(out, np.uint64), np.array(bounds, np.int64)


def pairs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first token follows an end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1]] = words[-1:]  # any text's last token is the end
    return mixed(mixed(before) + words)


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / math.log(LOG_BASE) + 1e-9)).astype(np.int64)


def typical(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for level 0."""
    low = np.ceil(LOG_BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(LOG_BASE ** level.astype(float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


# -- exact word counts ------------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts, ends included; each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.binary()).cast(pa.string()), pa.array(list(sums.values()), pa.int64())],
                ["word", "n"])
            sums.clear()
            return out

        for batch in small_batches(batches, 2 << 20):
            texts = as_bytes(batch.column("text"))
            for text in texts:
                sums.update(tokens(text))
            sums[END.encode()] += len(texts)
            if len(sums) > _FLUSH_WORDS:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int

    def log_probability(self, count):
        """Of words with these counts, by their own frequency alone."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


#: Of a word that the head may hold.
_IS_SHORT = f"octet_length(word) <= {HEAD_BYTES}"


def head(counts: DataFrame, most: int = HEAD_WORDS) -> tuple[dict[bytes, int], int]:
    """Counts of the most frequent words that are not too long, at most ``most``, and the least count that they have.

    The bound is a count that at most that many words reach, found from a table of words per power of two.
    """
    power = F.floor(F.log2("n")).cast("int").alias("power")
    counts, reached, least = counts.where(_IS_SHORT), 0, 1
    for row in sorted(counts.groupBy(power).count().collect(), key=lambda r: -r["power"]):
        reached += row["count"]
        if reached > most:
            least = 2 ** (row["power"] + 1)
            break
    rows = counts.where(F.col("n") >= least).select(F.col("word").cast("binary").alias("word"), "n").toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist())), least


# -- the filter ---------------------------------------------------------------------------------------

def _places(grams: np.ndarray, level: int, bits) -> list[np.ndarray]:
    """The probes of a level of each n-gram, below ``bits``."""
    one = mixed(grams + np.uint64(0x9E3779B97F4A7C15 * level % 2**64))
    two = mixed(one) | np.uint64(1)
    return [(one + np.uint64(i) * two) % bits for i in range(PROBES)]


def gram_sums(texts: DataFrame, segments: int) -> DataFrame:
    """``segment``, ``grams``, ``counts``: sorted hashes and their counts as bytes, one row per task chunk and segment.

    An n-gram's segment is its hash's leading bits, so a segment is a slice of a sorted chunk.
    """
    shift = np.uint64(64 - max(1, segments.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            where, starts = np.unique(grams >> shift, return_index=True)
            ends = np.append(starts[1:], len(grams))
            counts = counts.astype(np.uint32)
            for k in range(0, len(where), _FLUSH_SEGMENTS):
                some = list(zip(starts[k:k + _FLUSH_SEGMENTS], ends[k:k + _FLUSH_SEGMENTS]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[k:k + _FLUSH_SEGMENTS].astype(np.int32)),
                     pa.array([grams[a:b].tobytes() for a, b in some], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())],
                    ["segment", "grams", "counts"])

        for batch in small_batches(batches):
            words, bounds = hashed(as_bytes(batch.column("text")), known)
            held += [mixed(words), pairs(words, bounds)]
            size += 2 * len(words)
            if size > _CHUNK_TOKENS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return texts.select("text").mapInArrow(run, "segment int, grams binary, counts binary")


def _segment(grams: list[bytes], counts: list[bytes], least_count: int) -> tuple[int, bytes]:
    """Length in bits, and the bits."""
    distinct, back = np.unique(np.concatenate([np.frombuffer(g, np.uint64) for g in grams]), return_inverse=True)
    sums = np.bincount(back, np.concatenate([np.frombuffer(c, np.uint32) for c in counts]))
    distinct, sums = distinct[sums >= least_count], sums[sums >= least_count]
    if not len(distinct):
        return 0, b""
    level = levels(sums)
    bits = 64 * -(-int(level.sum()) * BITS_PER_ENTRY // 64)
    out = np.zeros(bits, np.bool_)
    for q in range(1, int(level.max()) + 1):
        for place in _places(distinct[level >= q], q, np.uint64(bits)):
            out[place] = True
    return bits, np.packbits(out, bitorder="little").tobytes()


def segments_of(sums: DataFrame, segments: int, least_count: int = 1) -> DataFrame:
    """``segment``, ``bits`` and ``filter``, one row per segment, of n-grams that come at least ``least_count`` times.

    Parts are by number, so that adaptive execution does not merge them: a task's rows may reach Python in one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, grams, counts = None, [], []

        def done() -> pa.RecordBatch:
            bits, data = _segment(grams, counts, least_count)
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([bits], pa.int64()), pa.array([data], pa.binary())],
                ["segment", "bits", "filter"])

        for batch in batches:
            for segment, g, c in zip(*(column.to_pylist() for column in batch.columns)):
                if segment != current and grams:
                    yield done()
                    grams, counts = [], []
                current = segment
                grams.append(g)
                counts.append(c)
        if grams:
            yield done()

    parts = max(min(segments, int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))), segments // _TASK_SEGMENTS)
    placed = sums.repartition(parts, "segment").sortWithinPartitions("segment")
    return placed.mapInArrow(run, "segment int, bits bigint, filter binary")


@dataclass(frozen=True)
class Shard:
    """Consecutive segments ``first`` to ``last`` of a filter with ``2 ** (64 - shift)`` segments in all."""

    shift: int
    first: int
    last: int
    bits: np.ndarray
    start: np.ndarray
    data: bytes

    def levels_of(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram; 0 for those that belong to other shards."""
        out = np.zeros(len(grams), np.int64)
        segment = (grams >> np.uint64(self.shift)).astype(np.int64)
        own = np.flatnonzero((segment >= self.first) & (segment <= self.last))
        own = own[self.bits[segment[own] - self.first] > 0]
        data, at = np.frombuffer(self.data, np.uint8), segment[own] - self.first
        bits, start, grams = self.bits[at].astype(np.uint64), self.start[at], grams[own]
        level = 0
        while len(own) and level < _TOP_LEVEL:
            level += 1
            there = np.ones(len(own), bool)
            for place in _places(grams, level, bits):
                byte = data[start + (place >> np.uint64(3)).astype(np.int64)]
                there &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            own, bits, start, grams = own[there], bits[there], start[there], grams[there]
            out[own] = level
        return out

    @classmethod
    def of(cls, rows, segments: int) -> Shard:
        rows = sorted(rows, key=lambda r: r["segment"])
        first, last = (rows[0]["segment"], rows[-1]["segment"]) if rows else (0, -1)
        bits, start, size = np.zeros(last - first + 1, np.int64), np.zeros(last - first + 1, np.int64), 0
        for r in rows:
            bits[r["segment"] - first], start[r["segment"] - first] = r["bits"], size
            size += r["bits"] // 8
        return cls(64 - max(1, segments.bit_length() - 1), first, last, bits, start, b"".join(bytes(r["filter"]) for r in rows))


def shard_ranges(sizes: list[tuple[int, int]], limit: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """Ranges of segments whose filters take at most ``limit`` bytes together (or are one segment)."""
    ranges, size = [], 0
    for segment, bits in sorted(sizes):
        if ranges and size + bits // 8 <= limit:
            ranges[-1] = (ranges[-1][0], segment)
            size += bits // 8
        else:
            ranges.append((segment, segment))
            size = bits // 8
    return ranges or [(0, 0)]


# -- scoring --------------------------------------------------------------------------------------------

def _levels_of_texts(shard: Shard, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of each token and of each pair, as far as the shard holds them; equal n-grams are probed once."""
    out = []
    for grams in (mixed(words), pairs(words, bounds)):
        distinct, back = np.unique(grams, return_inverse=True)
        out.append(shard.levels_of(distinct)[back])
    return out[0], out[1]


def log_probabilities(one: np.ndarray, two: np.ndarray, bounds: np.ndarray, end: int, totals: Totals) -> np.ndarray:
    """Sum of log10 probabilities of each text, from the levels of its words and pairs."""
    count = typical(one)
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[bounds[:-1]] = typical(np.array([end]))[0]
    pair = np.minimum(typical(two), np.minimum(count, before))
    own = 10.0 ** totals.log_probability(count)
    p = np.log10((pair + SMOOTHING * own) / (before + SMOOTHING))
    return np.add.reduceat(p, bounds[:-1])


def _fill(docs: DataFrame, shard: Shard) -> DataFrame:
    """Merge what the shard knows into ``one`` and ``two``, a byte per token each; staged, so that the shard can go."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    known = WordHashes()

    def of_batch(batch: pa.RecordBatch) -> list:
        words, bounds = hashed(as_bytes(batch.column("text")), known)
        found = _levels_of_texts(shared.value, words, bounds)
        new = []
        for name, level in zip(("_one", "_two"), found):
            old = np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8) if name in batch.schema.names else 0
            level = np.maximum(level, old).astype(np.uint8)
            new.append([level[a:b].tobytes() for a, b in zip(bounds, bounds[1:])])
        return new

    kept = [c for c in docs.columns if c not in ("_one", "_two")]
    filled = map_rows(docs, of_batch, "_new_one binary, _new_two binary")
    filled = stage(filled.select(*kept, F.col("_new_one").alias("_one"), F.col("_new_two").alias("_two")), "token_levels")
    if filled.staged_path is not None:  # what is cached may be computed again
        shared.destroy()
    return filled


class Model:
    """Exact word counts, and the filter's segments in a staged table."""

    def __init__(self, texts: DataFrame, head_words: int = HEAD_WORDS, shard_bytes: int = SHARD_BYTES, *,
                 least_count: int = 1) -> None:
        texts = texts.select("text")
        self.counts = stage(word_counts(texts).where("n > 0"), "word_counts")
        n, v = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.totals = Totals(n, v)
        self.head, self.least = head(self.counts, head_words)
        self.segments = 1 << max(1, math.ceil(math.log2(max(2, n / SEGMENT_TOKENS))))
        self.filter = stage(segments_of(gram_sums(texts, self.segments), self.segments, least_count), "filter_segments")
        self.ranges = shard_ranges([tuple(r) for r in self.filter.select("segment", "bits").collect()], shard_bytes)

    def shard(self, first: int, last: int) -> Shard:
        return Shard.of(self.filter.where(F.col("segment").between(first, last)).collect(), self.segments)

    def level_of_end(self) -> int:
        gram = mixed(np.array([xxh64_intdigest(END.encode())], np.uint64))
        segment = int(gram[0] >> np.uint64(64 - max(1, self.segments.bit_length() - 1)))
        return int(self.shard(segment, segment).levels_of(gram)[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``base_score`` and ``score`` to documents, whose ``text`` goes.

    Columns that begin with an underscore are the operator's own.
    """
    spark, totals = docs.sparkSession, model.totals
    for first, last in model.ranges[:-1]:
        docs = _fill(docs, model.shard(first, last))
    shared = spark.sparkContext.broadcast(model.shard(*model.ranges[-1]))
    words = spark.sparkContext.broadcast(model.head)
    end_level, known = model.level_of_end(), WordHashes()

    def of_batch(batch: pa.RecordBatch) -> list:
        texts = as_bytes(batch.column("text"))
        hashes, bounds = hashed(texts, known)
        one, two = _levels_of_texts(shared.value, hashes, bounds)
        if "_one" in batch.schema.names:
            one = np.maximum(one, np.frombuffer(b"".join(batch.column("_one").to_pylist()), np.uint8))
            two = np.maximum(two, np.frombuffer(b"".join(batch.column("_two").to_pylist()), np.uint8))
        scores = log_probabilities(one, two, bounds, end_level, totals)
        base, found, rare, times = [], [], [], []
        of_head, end = words.value, END.encode()
        for text in texts:
            distinct = Counter(tokens(text))
            distinct[end] = 1
            count = [of_head.get(w, 0) for w in distinct]
            often = np.fromiter(distinct.values(), np.int64, len(distinct))
            count = np.array(count, np.int64)
            is_head = count > 0
            base.append(float((often * totals.log_probability(count))[is_head].sum()))
            found.append(int(often[is_head].sum()))
            tail = [(w, n) for (w, n), h in zip(distinct.items(), is_head) if not h]
            rare.append([w.decode() for w, _ in tail])
            times.append([n for _, n in tail])
        return [np.diff(bounds), found, base, scores, rare, times]

    added = "n_tokens bigint, _found bigint, _base double, score double, _rare array<string>, _times array<bigint>"
    rows = map_rows(docs, of_batch, added).drop("text", "_one", "_two").withColumn("_row", F.monotonically_increasing_id())
    rows = stage(rows, "scored_rows")  # fixes the row numbers
    rare = rows.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("_w"))
    rare = rare.select("_row", F.col("_w._rare").alias("word"), F.col("_w._times").alias("times"))
    if rows.staged_path is not None:
        shared.destroy()
        words.destroy()
    counts = model.counts.where((F.col("n") < model.least) | ~F.expr(_IS_SHORT))
    n = F.coalesce("n", F.lit(0))
    log = F.log10((n + 0.5) / F.lit(totals.tokens + 0.5 * (totals.distinct + 1)))
    of_rare = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("times") * log).alias("_rare_base"), F.sum(F.when(n > 0, F.col("times"))).alias("_rare_found"))
    return rows.join(of_rare, "_row", "left").withColumn(
        "n_known", F.col("_found") + F.coalesce("_rare_found", F.lit(0))).withColumn(
        "base_score", F.col("_base") + F.coalesce("_rare_base", F.lit(0.0))).drop(
        "_row", "_found", "_base", "_rare", "_times", "_rare_base", "_rare_found")


def query(docs: DataFrame) -> DataFrame:
    model = Model(docs.where(is_learned(*HELD_OUT)))
    rows = docs.select("doc_id", is_held_out(*HELD_OUT).alias("held_out"), "text")
    return score(rows, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score")
