"""Benchmark decontamination: documents that hold a window of ten words of a benchmark item.

Windows are searched with Wu-Manber tables that every task gets by broadcast. The tables are built from
packs of about ``PACK_WORDS`` words of items at most, as a table takes some 700 bytes per window: a larger benchmark is
searched pack by pack, each pack over all documents, and the hits of a document are then united. Longer items are cut
into pieces that overlap by nine words, which have the same windows, so no item is larger than a pack.

Defined results: null text has no words, is never hit, and a null or wordless item has no windows; an item
without ``item_id`` still marks words but is not counted; items that share a window are all counted;
repeated rows come back as often as they came in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.text import as_bytes, filter_rows, map_rows, small_batches
from panelcast.llm.wumanber import WuManber
from panelcast.sources.stage import stage

WINDOW = 10
PACK_WORDS = 200_000
PIECE_WORDS = 10_000

#: Bytes of UTF-8: A-Z become a-z; other ASCII but digits and a-z separates words; all others belong to words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def searchers(items: list[tuple[str | None, bytes | None]]) -> list[WuManber]:
    """One search per length of window: ten words, and what the shorter items have."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item_id, text in items:
        tokens = item_words(text)
        size = min(WINDOW, len(tokens))
        if not size:
            continue
        patterns = by_length.setdefault(size, {})
        for i in range(len(tokens) - size + 1):
            owners = patterns.setdefault(tuple(tokens[i:i + size]), set())
            if item_id is not None:
                owners.add(item_id)
    return [WuManber({p: tuple(sorted(o)) for p, o in patterns.items()}, size)
            for size, patterns in sorted(by_length.items())]


def hits(text: bytes | None, search: list[WuManber]) -> tuple[int, list[int], list[str]]:
    """Number of words, places of the words that are hit, and items with occurring windows."""
    tokens = item_words(text)
    places, items = set(), set()
    for s in search:
        for start, owners in s.search(tokens):
            places.update(range(start, start + s.length))
            items.update(owners)
    return len(tokens), sorted(places), sorted(items)


def cut(tokens: list[bytes], length: int = PIECE_WORDS) -> list[list[bytes]]:
    """Pieces that start ``length`` words apart and have, all together, the windows of the whole."""
    return [tokens[i:i + length + WINDOW - 1] for i in range(0, max(1, len(tokens) - WINDOW + 1), length)]


def pieces(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``n`` words, and the words themselves, for every piece of an item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for item_id, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text"))):
                own = [p for p in cut(item_words(text)) if p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_id] * len(own), pa.string()), pa.array([len(p) for p in own], pa.int64()),
                     pa.array([b" ".join(p) for p in own], pa.binary())], ["item_id", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id string, n bigint, words binary")


def packs(benchmark: DataFrame, pack_words: int = PACK_WORDS):
    """The searchers of each pack; the driver holds one pack's words at a time."""
    rows = stage(pieces(benchmark).distinct(), "benchmark_pieces")
    n = -(-(rows.agg(F.sum("n")).first()[0] or 0) // pack_words) or 1
    for k in range(n):
        pack = rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k)
        yield searchers([(r["item_id"], bytes(r["words"])) for r in pack.collect()])


def _scan(docs: DataFrame, search: list[WuManber]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(search)

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        found = [hits(t, shared.value) for t in as_bytes(batch.column("text"))]
        return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    return map_rows(docs, of_batch, "n_words bigint, places array<int>, items array<string>")


def find_hits(docs: DataFrame, benchmark: DataFrame, pack_words: int = PACK_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of the hit words and ``items`` (ids as text), one row per document."""
    rows = docs.select("doc_id", "text")
    found = [_scan(rows, search) for search in packs(benchmark, pack_words)]
    if len(found) == 1:
        return found[0].drop("text")
    key = F.xxhash64("text").alias("text_hash")
    parts = [f.select("doc_id", key, F.lit(k == 0).alias("counts"), "n_words", "places", "items")
             for k, f in enumerate(found)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part.where(F.size("places") > 0))
    # rows alike in id and text have the same hits; they are united once and come back as often as they came
    union = every.groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("counts").cast("int")).alias("copies"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return union.select("n_words", "places", "items", "doc_id", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = F.array_sort("items")
    return find_hits(docs, benchmark).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, pack_words: int = PACK_WORDS) -> DataFrame:
    """The documents, all columns, that no window occurs in."""
    spark = docs.sparkSession
    for search in packs(benchmark, pack_words):
        shared = spark.sparkContext.broadcast(search)

        def clean(batch: pa.RecordBatch, shared=shared) -> list[bool]:
            return [not hits(t, shared.value)[1] for t in as_bytes(batch.column("text"))]

        docs = filter_rows(docs, clean)
    return docs
