"""Merkle manifest of a data set: a ternary hash tree per source over its documents, and one over the sources.

Leaves lie in order within blocks of ``WIDTH`` = 3^6. In a block, level k keeps its nodes on the first leaf below
them, so the children of a run of three are found at fixed offsets of 3^k rows by lag and lead, masked by the slot in the run and by
the run's length, and the first child's row hashes the parent. All six levels of a block need one shuffle by
source and block; what stands on its first row is a leaf of the next tree, and so on up to one node a source. Coming
down again, each leaf gets the siblings along its way: ``left`` and ``right`` are the digests before and after its
ancestor in the run.

Defined results: a null source is a source of its own, before all others; rows of a source are ordered by
``doc_id`` (null first), then by digest, so repeated rows are neighbours and have leaves of their own; a row without
``doc_id`` is never tampered with; a table of one row has that leaf as its root; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ordinals import running_total, total_within
from panelcast.sources.stage import stage

LEVELS = 6
WIDTH = 3 ** LEVELS
STEP = "struct<left:string,right:string>"
#: The parts of a leaf, in order.
PARTS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as lowercase hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**replaced: Column) -> Column:
    """Digest of a document: its parts with their lengths in bytes, ``-`` for null."""
    parts = []
    for name in PARTS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def tampered_text(key: str = "doc_id") -> Column:
    """The text without line feeds where the checksum of the id is even, else as it is."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def _climb_block(nodes: DataFrame) -> DataFrame:
    """Add to ``group, idx, n, digest``: ``block``, ``path`` within the block, and ``top``, the block's node.

    ``idx`` counts a group's nodes from 0 without gaps, and ``n`` is how many there are.
    """
    in_order = Window.partitionBy("group", "block").orderBy("idx")
    # a fixed number of blocks' rows share a task, so a group of any size is spread over many
    rows = nodes.withColumn("block", F.floor(F.col("idx") / WIDTH).cast("bigint")).withColumn("_d0", F.col("digest"))
    for level in range(LEVELS):
        size = 3 ** level
        node = F.floor(F.col("idx") / size).cast("bigint")
        count = F.ceil(F.col("n") / size).cast("bigint")
        slot = node % 3
        run = F.least(F.lit(3), count - (node - slot))
        own = f"_d{level}"
        near = rows.select("*", *[
            f(own, size * k).over(in_order).alias(f"_{name}{k}")
            for name, f in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)
        ])
        none = F.lit("")
        left = F.concat(F.when(slot == 2, F.col("_lag2")).otherwise(none), F.when(slot >= 1, F.col("_lag1")).otherwise(none))
        right = F.concat(F.when(slot + 1 < run, F.col("_lead1")).otherwise(none),
                         F.when(slot + 2 < run, F.col("_lead2")).otherwise(none))
        here, many = F.col("idx") % size == 0, count > 1
        parent = F.when(many, digest(F.col(own), right)).otherwise(F.col(own))
        rows = near.select(
            *rows.columns,
            F.when(here & many, F.struct(left.alias("left"), right.alias("right"))).alias(f"_s{level}"),
            F.when(F.col("idx") % (3 * size) == 0, parent).alias(f"_d{level + 1}"),
        )
    # the latest row that holds a node of a level is the first leaf below one's own ancestor there
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"_s{level}", ignorenulls=True).over(so_far).alias(f"_a{level}") for level in range(LEVELS)]
    top = F.first(f"_d{LEVELS}").over(so_far).alias("top")
    spread = rows.select(*nodes.columns, "block", *steps, top)
    path = F.filter(F.array(*[F.col(f"_a{level}") for level in range(LEVELS)]), lambda s: s.isNotNull())
    return spread.select(*nodes.columns, "block", path.alias("path"), "top")


def climb(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (``group, idx, n, digest`` and others) with ``path``, all steps up, and what ``above`` adds.

    ``above`` gets one row per group (``group``, ``digest`` of its last node) and returns it with a ``path`` that
    goes on from there and any further columns.
    """
    placed = _climb_block(nodes)
    tops = stage(placed.where(F.col("idx") % WIDTH == 0).select(
        "group", F.col("block").alias("idx"), F.ceil(F.col("n") / WIDTH).cast("bigint").alias("n"), F.col("top").alias("digest")),
        "merkle_tops")
    if tops.where("n > 1").isEmpty():
        upper = above(tops.select("group", "digest")).withColumn("block", F.lit(0).cast("bigint"))
    else:
        upper = climb(tops, above).drop("n", "digest").withColumnRenamed("idx", "block")
    upper = upper.withColumnRenamed("path", "_above")
    joined = placed.join(upper, ["group", "block"])  # one row above for up to WIDTH below, keyed as these are spread
    return joined.withColumn("path", F.concat("path", "_above")).drop("block", "top", "_above")


def _over_sources(tops: DataFrame) -> DataFrame:
    """The tree over the sources' last nodes: their ``path`` up, ``subroot`` and ``root``."""
    numbered = running_total(tops.select(F.col("group").alias("_source"), F.col("digest").alias("subroot")), ["_source"],
                             F.lit(1), "idx", "n")
    nodes = numbered.select(F.lit("").alias("group"), "idx", "n", F.col("subroot").alias("digest"), "_source", "subroot")
    root = climb(nodes, lambda last: last.select(
        "group", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root")))
    return root.select(F.col("_source").alias("group"), "path", "subroot", "root")


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root`` and the ``path`` of each document, and ``seen_leaf``.

    ``seen`` is the leaf of a copy of the documents that is to be verified; by default the documents' own.
    """
    own = leaf()
    leaves = stage(docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("group"), "doc_id", own.alias("digest"),
        (own if seen is None else seen).alias("seen_leaf"), F.monotonically_increasing_id().alias("_row")), "merkle_leaves")
    nodes = total_within(leaves, "group", ["doc_id", "digest", "_row"], F.lit(1), "idx", "n").drop("_row")
    return climb(nodes, _over_sources).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "seen_leaf")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def query(docs: DataFrame) -> DataFrame:
    found = manifest(docs.select(*PARTS), leaf(text=tampered_text()))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("seen_leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of an id's digits, a bit at a time; then trees level by level, and each leaf's way up in them.
SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, row_number() OVER () AS r, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
crc(r, rest, bits, state) AS (
  SELECT r, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM rows_ WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, CASE WHEN bits = 0 THEN substr(rest, 2) ELSE rest END, (bits + 1) % 9,
         CASE WHEN bits = 0 THEN xor(state, ascii(rest[1])::BIGINT)
              WHEN state % 2 = 1 THEN xor(state >> 1, 3988292384::BIGINT) ELSE state >> 1 END
  FROM crc WHERE bits > 0 OR rest <> ''),
leaves AS (
  SELECT w.r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen_leaf
  FROM (SELECT q.*, CASE WHEN xor(c.state, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen
        FROM rows_ q LEFT JOIN (SELECT * FROM crc WHERE bits = 0 AND rest = '') c ON q.r = c.r) w),
placed AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM leaves),
nodes(level, g, i, d) AS (
  SELECT 0, g, i, leaf FROM placed
  UNION ALL
  SELECT level + 1, g, i // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY level, g, i // 3),
tops AS (
  SELECT g, arg_max(d, level) AS subroot, max(level) AS height FROM nodes GROUP BY g),
numbered AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i FROM tops),
upper_(level, i, d) AS (
  SELECT 0, i, subroot FROM numbered
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM upper_) WHERE c > 1 GROUP BY level, i // 3),
last_ AS (SELECT max(level) AS height, arg_max(d, level) AS root FROM upper_),
ways AS (
  SELECT p.r, n.level, string_agg(CASE WHEN n.i < p.i // (3 ** n.level)::BIGINT THEN n.d END, '' ORDER BY n.i) AS l,
         string_agg(CASE WHEN n.i > p.i // (3 ** n.level)::BIGINT THEN n.d END, '' ORDER BY n.i) AS h
  FROM placed p JOIN tops t ON p.g = t.g JOIN nodes n ON n.g = p.g AND n.level < t.height
   AND n.i // 3 = (p.i // (3 ** n.level)::BIGINT) // 3 GROUP BY p.r, n.level
  UNION ALL
  SELECT p.r, 1000 + n.level, string_agg(CASE WHEN n.i < t.i // (3 ** n.level)::BIGINT THEN n.d END, '' ORDER BY n.i),
         string_agg(CASE WHEN n.i > t.i // (3 ** n.level)::BIGINT THEN n.d END, '' ORDER BY n.i)
  FROM placed p JOIN numbered t ON p.g = t.g JOIN upper_ n ON n.i // 3 = (t.i // (3 ** n.level)::BIGINT) // 3
  JOIN last_ z ON n.level < z.height GROUP BY p.r, n.level),
steps AS (
  SELECT r, coalesce(l, '') AS l, coalesce(h, '') AS h, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM ways),
folds(r, k, d) AS (
  SELECT r, 0, seen_leaf FROM placed
  UNION ALL
  SELECT f.r, f.k + 1, sha256(l || d || h) FROM folds f JOIN steps s ON f.r = s.r AND s.k = f.k + 1),
folded AS (SELECT r, arg_max(d, k) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN tops t ON p.g = t.g JOIN last_ ON true JOIN folded f ON p.r = f.r
LEFT JOIN (SELECT r, string_agg(l || h, '' ORDER BY k) AS proof FROM steps GROUP BY r) s ON p.r = s.r
"""
