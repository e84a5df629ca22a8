"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight that changes linearly over training time 0 to 1. Its integral, scaled to the
source's target, is the number of words demanded by any time; inverting it gives the time at which a
document's first word is due. Documents are sorted by that position.

A source is read in a fixed order (MD5 of the id and of the text) over and over until its target is reached, so all passes
but the last take whole documents and only one document per source is cut. Running totals are taken in
``BUCKETS`` hash ranges per source, so a source of any size is spread over many tasks.

Defined results: null, empty and blank text has size 0 and is never taken; a null source is a source of its
own, in the last place; rows with equal or null ids are spread by their texts; rows alike in id and text are separate
documents, one after another; a document that is not taken has no position; an empty table gives no rows. Columns
that the operator adds replace columns of the same name, others stay as they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.text import as_bytes, hidden, map_rows, words
from panelcast.operators.ordinals import running_total
from panelcast.sources.stage import stage

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: How far the lightest and heaviest weights lean: heavy sources fade by this share, light ones grow.
TILT = 0.5

_DIGITS = 3  # hexadecimal, so 4,096 buckets per source


def with_sizes(docs: DataFrame) -> DataFrame:
    """Add ``size``: the number of words of the whole text."""

    def of_batch(batch: pa.RecordBatch) -> list:
        return [[len(words(t)) for t in as_bytes(batch.column("text"))]]

    return map_rows(docs.drop("size"), of_batch, "size bigint")


def order_of() -> Column:
    """The place of a document within its source: the MD5 of its id and of its text's MD5."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text).cast("binary"))


def source_key() -> Column:
    """Tells sources apart and null from all of them."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def fill_level(sources: DataFrame, most_passes: int = MOST_PASSES) -> float:
    """Words per unit of weight at which the targets add up to all words, with no source above its passes.

    Each round is one aggregate over the sources; a round that caps no further source is the last.
    """
    capped, level = F.lit(False), 0.0
    before = None
    while True:
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum("weight").alias("weight"),
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("capped_size"),
            F.coalesce(F.sum(F.when(capped, F.col("weight"))), F.lit(0)).alias("capped_weight"),
        ).first()
        if not row["total"]:
            return 0.0
        level = (row["total"] - most_passes * row["capped_size"]) / (row["weight"] - row["capped_weight"])
        if row["capped_weight"] == before:
            return level
        before = row["capped_weight"]
        capped = F.col("weight") * level > most_passes * F.col("source_size")


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES,
            tilt: float = TILT) -> DataFrame:
    """Add ``weight``, ``target`` and the weights at either end of the schedule, ``_w0`` and ``_w1``, to sums by source."""
    placed = running_total(sums.withColumn("_last", F.col("source").isNull()), ["_last", "_source"], F.lit(1), "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stage(placed.withColumn("weight", weight.cast("bigint")), "source_weights")
    level = fill_level(sources, most_passes)
    capped = F.col("weight") * level > most_passes * F.col("source_size")
    sources = sources.withColumn(
        "target", F.when(capped, (most_passes * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level)))
    mean = sources.agg(F.try_divide(F.sum(F.col("target") * F.col("weight")), F.sum("target"))).first()[0] or 0.0
    lean = F.lit(tilt) * (F.col("weight") - F.lit(mean)) / max(1, max(weights) - min(weights))
    return sources.withColumn("_w0", 1 + lean).withColumn("_w1", 1 - lean).drop("_last", "_rank", "source")


def due(offset, total, w0, w1):
    """The time at which a source that is to give ``total`` words has given ``offset`` of them."""
    a, c = (w1 - w0) / 2, offset / total * (w0 + w1) / 2
    return 2 * c / (w0 + F.sqrt(w0 * w0 + 4 * a * c))


ADDED = ("size", "source_size", "target", "taken", "position")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES,
        tilt: float = TILT) -> DataFrame:
    """Add ``source_size``, ``target``, ``taken`` and ``position`` to documents with a ``size``.

    ``weights`` go to the sources in turn; no source is read more than ``most_passes`` times; at a ``tilt`` of
    0 all sources keep their share throughout, at 1 the heaviest may fade to nothing. ``sized`` is read twice: for the
    sums, and for the documents.
    """
    rows, own = hidden(sized.drop(*ADDED[1:]), ("doc_id", "source", "text", "size"))
    return _placed(rows.withColumn("_order", order_of()), weights, most_passes, tilt).select(*own, *ADDED[1:])


def _placed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES,
            tilt: float = TILT) -> DataFrame:
    """What ``mix`` adds, and the columns it is made of, to documents with ``doc_id``, ``source``, ``size`` and ``_order``."""
    rows = rows.withColumn("_source", source_key()).withColumn("_bucket", F.substring("_order", 1, _DIGITS))
    buckets = stage(rows.groupBy("_source", "source", "_bucket").agg(F.sum("size").alias("size")), "source_buckets")
    sums = buckets.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    wanted = stage(targets(sums, weights, most_passes, tilt), "source_targets")
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        "_source", "_bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.join(wanted, "_source").select("_source", "_bucket", "_start", "source_size", "target", "_w0", "_w1")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(starts, ["_source", "_bucket"]).withColumn("_before", F.col("_start") + inside)
    goal = F.floor(F.col("target") + 0.5)
    placed = placed.withColumn("_passes", F.coalesce(F.floor(F.try_divide(goal, F.col("source_size"))), F.lit(0)))
    left = goal - F.col("_passes") * F.col("source_size") - F.col("_before")
    placed = placed.withColumn(
        "taken", F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size"))))
    position = due(F.col("_before"), F.col("target"), F.col("_w0"), F.col("_w1"))
    return placed.withColumn("position", F.when(F.col("taken") > 0, position))


def query(docs: DataFrame) -> DataFrame:
    sized = with_sizes(docs.select("doc_id", "source", "text")).withColumn("_order", order_of())
    mixed = _placed(stage(sized.drop("text"), "document_sizes")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return mixed.orderBy(F.asc_nulls_last("position"), "doc_id")


def training_stream(docs: DataFrame) -> DataFrame:
    """Documents, all columns, once per pass that takes them, sorted by ``position``.

    ``taken`` is the number of words that the pass takes: all, but for one document of each source.
    """
    rows, own = hidden(docs.drop(*ADDED, "pass"), ("doc_id", "source", "text"))
    mixed = _placed(with_sizes(rows).withColumn("_order", order_of())).where("taken > 0")
    last = F.floor((F.col("taken") - 1) / F.col("size"))
    each = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    offset = F.col("pass") * F.col("source_size") + F.col("_before")
    words_now = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    position = due(offset, F.col("target"), F.col("_w0"), F.col("_w1"))
    return each.select(
        *own, "size", "source_size", "target", words_now.alias("taken"), position.alias("position"), "pass",
    ).orderBy("position", "doc_id", "pass")


#: Words by source, weights by rank, the level at which none is above its passes, and running totals by MD5.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(md5(text), '')) AS place FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
by_need AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source) AS k,
         sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_weight FROM sums),
levels AS (
  SELECT k, weight, source_size,
         (total - 3 * (sum(source_size) OVER w - source_size)) / (all_weight - (sum(weight) OVER w - weight))::DOUBLE AS level
  FROM by_need WINDOW w AS (ORDER BY k)),
chosen AS (SELECT level FROM levels WHERE weight * level <= 3 * source_size ORDER BY k LIMIT 1),
wanted AS (
  SELECT source, source_size, weight,
         CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM sums, chosen),
leaning AS (
  SELECT *, 0.5 * (weight - (SELECT sum(target * weight) / sum(target) FROM wanted)) / 4 AS lean FROM wanted),
placed AS (
  SELECT doc_id, size, source_size, target, lean,
         (sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before_words,
         floor(target + 0.5)::BIGINT AS goal
  FROM sized s JOIN leaning t ON s.source IS NOT DISTINCT FROM t.source),
takes AS (
  SELECT *, coalesce(goal // nullif(source_size, 0), 0) AS passes FROM placed),
mixed AS (
  SELECT *, (passes * size + greatest(0, least(goal - passes * source_size - before_words, size)))::BIGINT AS taken,
         1 + lean AS w0, 1 - lean AS w1, before_words / target * 2 / 2 AS c FROM takes)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * c / (w0 + sqrt(w0 * w0 + 4 * ((w1 - w0) / 2) * c)), 9) END AS position
FROM mixed
"""
