"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has a bit set where over half of the text's hashed three-word shingles have it.
Fingerprints within three bits are linked, and linked documents form components.

Two fingerprints that differ in at most three bits agree on one of four blocks of bits. So every
distinct fingerprint is placed in four shards, one per block, and each shard gets a BK-tree of its own,
built by the task that holds the shard and asked for each of the shard's fingerprints. Trees stay where
they are built: all of them together grow with the corpus. A shard of more than ``SHARD_LIMIT``
fingerprints is placed anew by four blocks of its remaining bits, again and again; after six rounds
twelve bits remain, so no tree can hold more than 4,096 nodes, however alike the texts are.

Exact copies share a fingerprint and are one node. Of the links in a shard only a spanning star per
linked group leaves the task.

Defined results: null, empty and blank text has fingerprint zero and is linked like any other; repeated
rows come back as often as they came in; a row without ``doc_id`` takes part, but a component is named by
the least ``doc_id`` there is (null if none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelcast.llm.bktree import groups
from panelcast.llm.components import components, is_hot, with_least
from panelcast.llm.text import as_bytes, hidden, map_rows, words
from panelcast.llm.wide_prints import similar_links, sketch
from panelcast.sources.stage import stage, staged_result

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = RADIUS + 1
SHARD_LIMIT = 1024
ROUNDS = 7

_PIECE = 1 << 15


def _votes(hashes: list[int]) -> np.ndarray:
    """For each bit, how many of the hashes have it."""
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the UTF-8 text."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(tokens))
    starts, ends = starts[: len(tokens) - size + 1], ends[size - 1:]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(starts), _PIECE):
        places = zip(starts[i:i + _PIECE].tolist(), ends[i:i + _PIECE].tolist())
        votes += _votes([xxh64_intdigest(joined[a:b], SEED) for a, b in places])
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, one row per document."""
    rows = map_rows(docs.select("doc_id", "text"), lambda b: [[fingerprint(t) for t in as_bytes(b.column("text"))]],
                    "fp bigint")
    return rows.select("doc_id", "fp")


def _blocks(width: int) -> list[tuple[int, int]]:
    """Offset and size of the four blocks that ``width`` bits are cut into."""
    sizes = [width // BLOCKS + (i < width % BLOCKS) for i in range(BLOCKS)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def _cut(rest: Column, offset: int, size: int, width: int) -> tuple[Column, Column]:
    """The block's bits, and the other bits closed up."""
    block = F.shiftrightunsigned(rest, offset).bitwiseAND(F.lit((1 << size) - 1))
    low = rest.bitwiseAND(F.lit((1 << offset) - 1))
    if offset + size == width:
        return block, low
    return block, F.shiftleft(F.shiftrightunsigned(rest, offset + size), offset).bitwiseOR(low)


def place(rows: DataFrame, width: int) -> DataFrame:
    """``fp``, ``rest`` and ``shard``: each row four times. A shard's number hashes the blocks that led to it."""
    choices = []
    for i, (offset, size) in enumerate(_blocks(width)):
        block, rest = _cut(F.col("rest"), offset, size, width)
        choices.append(F.struct(F.xxhash64("shard", F.lit(i), block).alias("shard"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*choices)).alias("at")).select("fp", "at.rest", "at.shard")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each shard; rows come ordered by shard, and one shard may span batches."""
    held_shard, held = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(shards: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(shards)) + 1
        bounds = np.concatenate([[0], cuts, [len(shards)]]) if len(shards) else np.zeros(1, np.int64)
        a, b = [], []
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            signed = fps[bounds[i]:bounds[i + 1]]
            own, signed = groups(signed.view(np.uint64).tolist(), RADIUS), signed.tolist()
            linked = [(x, signed[root]) for x, root in zip(signed, own) if x != signed[root]]
            a += [x for x, _ in linked]
            b += [y for _, y in linked]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        shards = np.concatenate([held_shard, batch.column("shard").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(shards):
            continue
        last = int(np.searchsorted(shards, shards[-1]))  # the last shard may go on in the next batch
        yield links(shards[:last], fps[:last])
        held_shard, held = shards[last:], fps[last:]
    yield links(held_shard, held)


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: edges between the distinct ``fp`` whose components are those of all pairs within the radius."""
    spark = distinct.sparkSession
    rows, width = distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("bigint").alias("shard")), 64
    found = spark.createDataFrame([], "a bigint, b bigint")
    for _ in range(ROUNDS):
        placed = place(rows, width)
        width -= width // BLOCKS  # the smallest block leaves the most bits
        large = stage(placed.groupBy("shard").count().where(F.col("count") > SHARD_LIMIT).select("shard"), "shards")
        some = not large.isEmpty() and width > 12
        fitting = placed.join(large, "shard", "left_anti") if some else placed
        fitting = fitting.select("shard", "fp").repartition("shard").sortWithinPartitions("shard")
        found = found.union(fitting.mapInArrow(_stars, "a bigint, b bigint"))
        if not some:
            break
        rows = stage(placed.join(large, "shard", "left_semi").select("fp", "rest", "shard"), "hot_shards")
    return found


def label(prints: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` for every distinct fingerprint of ``prints``."""
    least = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct_prints")
    roots = components(links(least), "print_links").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = stage(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "print_roots")
    named = with_least(placed, "root", "doc_id", "component_id", is_hot(placed, "root"))
    return named.select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, one row per document."""
    prints = stage(fingerprints(docs), "fingerprints")
    return prints.join(label(prints), "fp").select("doc_id", "fp", "component_id")


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, and the wide fingerprint ``wide`` with its shards ``keys``, one row per document."""

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        texts = as_bytes(batch.column("text"))
        sketches = [sketch(t) for t in texts]
        return [[fingerprint(t) for t in texts], [s[0] for s in sketches], [s[1] for s in sketches]]

    rows = map_rows(docs.select("doc_id", "text"), of_batch, "fp bigint, wide binary, keys array<bigint>")
    return rows.select("doc_id", "fp", "wide", "keys")


def least_of_edited(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The least ``doc_id`` of each group of documents that fingerprints or a similarity of 0.8 or more link."""
    named = found.where(F.col("doc_id").isNotNull())
    nodes = stage(named.groupBy("wide").agg(F.min("doc_id").alias("doc_id"), F.min("keys").alias("keys")), "wide_nodes")
    alike = stage(named.select("wide", "component_id").distinct(), "wide_components")
    starred = with_least(alike, "component_id", "wide", "least", is_hot(alike, "component_id"))
    edges = starred.select(F.col("wide").alias("a"), F.col("least").alias("b"))
    roots = components(edges.union(similar_links(docs, nodes)), "wide_links").select(F.col("a").alias("wide"), F.col("b").alias("root"))
    placed = nodes.select("wide", "doc_id").join(roots, "wide", "left")
    return placed.groupBy(F.coalesce("root", "wide")).agg(F.min("doc_id").alias("_kept_id")).select("_kept_id")


def keep_first(docs: DataFrame, edited: bool = False) -> DataFrame:
    """One document of each component, with all its columns: the one with the least ``doc_id``.

    With ``edited``, documents of five-word shingle sets of a similarity of 0.8 or more are linked as well, found by
    their wide fingerprints and compared exactly (see ``wide_prints``); rows without ``doc_id`` take no part in that.
    Of several rows with the least ``doc_id`` the first by text stays. Without any ``doc_id`` in a component
    the first row by text stays.
    """
    docs, own = hidden(docs, ("doc_id", "text"))
    if edited:
        spark, prints = docs.sparkSession, stage(wide_fingerprints(docs), "wide_fingerprints")
        found = prints.join(staged_result(spark, "print_components", lambda: label(prints)), "fp")
        named = staged_result(spark, "edited_ids", lambda: least_of_edited(docs, found))
    else:
        found = near_duplicates(docs)
        named = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept_id"))
    # texts are sorted for ids that come several times only, and joined to the ids that do not simply stay, which are few
    # in most corpora; written, so that the planner knows how few
    times = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_times"))
    marked = times.join(named.select(F.col("_kept_id").alias("doc_id"), F.lit(True).alias("_stays")).distinct(), "doc_id", "left")
    apart = stage(marked.where("_times > 1 or _stays is null").withColumnRenamed("doc_id", "_kept_id"), "ids_apart")
    same = F.col("doc_id") == F.col("_kept_id")
    once = docs.where(F.col("doc_id").isNotNull()).join(apart.select("_kept_id"), same, "left_anti")
    several = docs.join(apart.where("_stays").select("_kept_id"), same, "left_semi")
    kept = once.union(_first_of(several, "doc_id"))
    # components that consist of rows without doc_id only
    nameless = docs.where(F.col("doc_id").isNull())
    of_text = map_rows(nameless, lambda b: [[fingerprint(t) for t in as_bytes(b.column("text"))]], "_fp bigint")
    alone = found.where(F.col("component_id").isNull()).select("fp").distinct()
    if alone.isEmpty():
        return kept.select(own)
    roots = components(links(alone), "nameless_links").toDF("_fp", "_root")
    of_text = of_text.join(alone.toDF("_fp"), "_fp", "left_semi").join(roots, "_fp", "left")
    first = _first_of(of_text.withColumn("_root", F.coalesce("_root", "_fp")), "_root")
    return kept.union(first.select(docs.columns)).select(own)


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    orderable = [c for c, t in rows.dtypes if c != key and "map<" not in t and t != "variant"]
    order = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in orderable])
    return rows.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
