"""Ranked lexical search: the best documents of a corpus for each item of a query set.

Each document's terms are counted once; what is kept of it is its length and its postings for terms that any item
has. Corpus statistics come from plain aggregates over these rows. Then every task cuts its rows into
segments, builds their posting lists with range-maximum sparse tables, and lets each item's best-first interval search
(``interval_search``) improve the item's best documents, which carry over from segment to segment as the bar for the next.
A task hands on its best rows alone; they meet first in salted groups and then by item.

The query set is searched in packs of about ``PACK_BYTES`` of text, whose terms are broadcast: 2 MB of text have at
most about 700,000 terms, some 120 MB in a worker's memory. A larger query set takes one pass over the documents per pack. One item that is
longer than a pack is a pack of its own.

Defined results: null, empty and wordless text has no terms, is no document of the statistics and is never found; a
null ``doc_id`` is found like any other and comes last among equal scores, where it counts as the greatest 64-bit
number; repeated document rows are separate documents, and repeated item rows separate items; an item
without terms, or whose terms no document has, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.decontaminate import item_words
from panelcast.llm.interval_search import Best, Segment
from panelcast.llm.text import as_bytes, map_rows, small_batches
from panelcast.sources.stage import stage

BEST = 10
PACK_BYTES = 2 << 20
SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 1 << 20
#: Parts of a very long text, which end at a space.
PART_BYTES = 4 << 20
SALTS = 64

_NAMELESS = np.iinfo(np.int64).max


def parts_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a part at a time; ASCII that belongs to no term ends a part."""
    at = 0
    while text is not None and at < len(text):
        end = min(at + PART_BYTES, len(text))
        while end < len(text) and (text[end:end + 1].isalnum() or text[end] >= 0x80):
            end += 1
        yield item_words(text[at:end])
        at = end


def term_counts(text: bytes | None, numbers: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """All terms of a text with repeats, and the numbered ones of it with their counts."""
    total, counts = 0, Counter()
    for terms in parts_of(text):
        total += len(terms)
        counts.update(map(numbers.get, terms))
    counts.pop(None, None)
    return total, list(counts), list(counts.values())


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` terms, and the ``terms`` that are numbered with their ``counts``."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        found = [term_counts(t, shared.value) for t in as_bytes(batch.column("text"))]
        return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    rows = map_rows(docs.select("doc_id", "text"), of_batch, "n bigint, terms array<int>, counts array<bigint>")
    return rows.select("doc_id", "n", "terms", "counts")


def packs(items: DataFrame, pack_bytes: int = PACK_BYTES) -> Iterator[list[tuple]]:
    """Item id, terms and number of equal rows of each item, a pack at a time."""
    rows = items.groupBy("item_id", F.col("text").cast("binary").alias("text")).agg(F.count("*").alias("copies"))
    rows = stage(rows.where("octet_length(text) > 0"), "search_items")
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pack_bytes)
    for k in range(n):
        pack = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [(r["item_id"], sorted(set(item_words(bytes(r["text"])))), r["copies"]) for r in pack]


def weights(frequencies: dict[int, int], n_terms: int, n_docs: int) -> np.ndarray:
    """Weight of each numbered term, 0 for those in no document."""
    found = np.zeros(n_terms, np.int64)
    for term, df in frequencies.items():
        found[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return found


def segments(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[Segment]:
    """Segments of the rows, in order of ``doc_id`` inside; a longer document than the limit is a segment's last."""
    held: list[tuple] = []

    def build() -> Segment:
        keys = np.concatenate([h[0] for h in held])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        docs = place[np.repeat(np.arange(len(keys)), np.concatenate([h[1] for h in held]))]
        return Segment(keys[order], np.concatenate([h[2] for h in held]), docs, np.concatenate([h[3] for h in held]))

    for batch in small_batches(batches, SEGMENT_POSTINGS * 12):
        for start in range(0, batch.num_rows, SEGMENT_DOCS):
            part = batch.slice(start, SEGMENT_DOCS)
            keys = part.column("doc_id").fill_null(_NAMELESS).to_numpy(zero_copy_only=False)
            lengths = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
            tf = part.column("counts").flatten().to_numpy(zero_copy_only=False)
            m = np.repeat(part.column("m").to_numpy(zero_copy_only=False), lengths)
            held.append((keys, lengths, terms, weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))))
            if sum(len(h[0]) for h in held) >= SEGMENT_DOCS or sum(len(h[2]) for h in held) >= SEGMENT_POSTINGS:
                yield build()
                held.clear()
    if held:
        yield build()


def _search(rows: DataFrame, terms: list[list[int]], weight: np.ndarray, best: int) -> DataFrame:
    """``item`` (its number), ``doc_id`` and ``score``: the best of each task."""
    shared = rows.sparkSession.sparkContext.broadcast(([np.array(t, np.int64) for t in terms], weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        found = [Best(best) for _ in wanted]
        for segment in segments(batches, weight):
            for own, its in zip(wanted, found):
                segment.search(own, its)
        for item, its in enumerate(found):
            if len(its.keys):
                ids = pa.array(its.keys, mask=its.keys == _NAMELESS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(its.keys), item), pa.int64()), ids, pa.array(its.scores)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def best_of(rows: DataFrame, by: list[str], best: int) -> DataFrame:
    """The best rows of each group with their ``rank``; groups meet in salted parts first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy(*by, "salt").orderBy(*order))
    few = salted.withColumn("rank", part).where(F.col("rank") <= best).drop("salt", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of the best documents of each item."""
    spark, id_type = docs.sparkSession, items.schema["item_id"].dataType
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    result = spark.createDataFrame([], T.StructType([
        T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    listed = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", id_type), T.StructField("copies", T.IntegerType())])
    for pack in packs(items, pack_bytes):
        numbers = {term: k for k, term in enumerate(sorted({t for _, terms, _ in pack for t in terms}))}
        rows = stage(postings(docs, numbers), "postings").where("n > 0")
        n_docs, n_all = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        each = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
        weight = weights({r["term"]: r["count"] for r in each.collect()}, len(numbers), n_docs)
        # n * N outgrows 64 bits for very long texts in a very large corpus
        m = F.expr(f"10 + (CAST(90 * n AS DECIMAL(20, 0)) * CAST({n_docs} AS DECIMAL(18, 0))) DIV {n_all}")
        found = _search(rows.withColumn("m", m), [[numbers[t] for t in terms] for _, terms, _ in pack], weight, best)
        ids = spark.createDataFrame([(k, item_id, copies) for k, (item_id, _, copies) in enumerate(pack)], listed)
        named = best_of(found, ["item"], best).join(ids, "item")
        each_copy = named.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
        result = result.union(each_copy.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return result


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


#: Every pair of an item and a document that share a term.
SQL = r"""
WITH words AS (
  SELECT doc_id, r, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
counts AS (SELECT doc_id, r, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, r, term),
lengths AS (SELECT r, count(*)::BIGINT AS n FROM words GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM lengths),
frequencies AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, whole GROUP BY term, n_docs),
impacts AS (
  SELECT doc_id, c.r, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))) AS impact
  FROM counts c JOIN lengths l ON c.r = l.r JOIN frequencies f ON c.term = f.term, whole),
wanted AS (
  SELECT DISTINCT item_id, i, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark)),
scores AS (
  SELECT item_id, i, doc_id, r, sum(impact)::BIGINT AS score
  FROM wanted JOIN impacts USING (term) GROUP BY item_id, i, doc_id, r HAVING sum(impact) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
