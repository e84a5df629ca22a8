"""Wide SimHash fingerprints over five-word shingles, for copies that were edited.

Texts whose shingle sets have a similarity (Jaccard) of 0.8 differ in about 15 % of the bits of a SimHash, which in
64 bits is more than blocks of equal bits can find. So a fingerprint here has 256 bits, and a text is filed
in ``VIEWS`` shards, each named by the least ``KEY_SHINGLES`` shingles under an order of its own: two texts
of similarity ``s`` share a given shard with probability of about ``s ** 4``, and at 0.8 some shard in 99.8 % of cases.
Each shard gets a BK-tree in the task that holds it, which groups fingerprints within ``RADIUS`` bits.

That is the search. Groups of all shards are joined to clusters, and the shingle sets of clustered texts, and of
those alone, are brought together once per cluster, where a BK-tree proposes pairs and the exact similarity decides:
texts are linked at ``SIMILARITY`` or more and never below.

A shard of more than ``SHARD_LIMIT`` fingerprints is dealt into chunks. Each chunk has a tree of its own, and one
fingerprint of each group found goes on to the next round, until the shard fits or few more merge. Clusters of more
than ``CLUSTER_LIMIT`` texts or ``CLUSTER_SHINGLES`` shingles are dealt likewise. These rounds are a short cut that joins
what is plainly alike. What a dealt shard or cluster then holds in several components is compared in full: all its
members, representatives or not, are dealt into chunks once more, and any two of different components meet in a part
(``crossed``). So the work of a large group grows with the pairs that its components leave open, in tasks of two
chunks each; no round or limit ends it.

Defined results: null and blank text has fingerprint zero and is in no shard; a text of fewer than five words is
one shingle; repeated shingles count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelcast.llm.bktree import BKTree, groups
from panelcast.llm.components import components
from panelcast.llm.text import as_bytes, map_rows, words
from panelcast.sources.stage import stage

SHINGLE = 5
BITS = 256
VIEWS = 12
KEY_SHINGLES = 4
#: At a similarity of 0.8, 39 bits are expected to differ, with a deviation of 5.7; this is three deviations more.
RADIUS = 57
SHARD_LIMIT = 1024
ROUNDS = 8
SIMILARITY = Fraction(4, 5)
CLUSTER_LIMIT = 512
CLUSTER_SHINGLES = 4 << 20

_PIECE = 1 << 14
_NOTHING = bytes(BITS // 8)
_STEP = 0x9E3779B97F4A7C15
#: One salt for each view, then one for each 64 bits of the fingerprint.
_SALTS = np.array([(200 + i) * _STEP % 2**64 for i in range(VIEWS + BITS // 64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them; ``x`` is overwritten."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _bit_sums(octets: np.ndarray) -> np.ndarray:
    """How many rows have each bit; blocks of 255 rows are summed in bytes."""
    bits = np.unpackbits(octets, axis=1)
    even = len(bits) // 255 * 255
    blocks = bits[:even].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return blocks.sum(axis=0, dtype=np.int64) + bits[even:].sum(axis=0, dtype=np.uint8)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles of the lower-cased text, in ascending order."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    of_word = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(tokens))
    n = len(tokens) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h ^= of_word[i:i + n]
        h += np.uint64((i + 1) * _STEP % 2**64)
        _mixed(h)
    return np.unique(h)


def sketch(text: bytes | None) -> tuple[bytes, list[int]]:
    """The fingerprint and the shards of a text."""
    return sketch_of(shingle_hashes(text))


def sketch_of(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint and the shards of a shingle set."""
    if not len(h):
        return _NOTHING, []
    votes = np.zeros(BITS, np.int64)
    least = np.empty((VIEWS, 0), np.uint64)
    for start in range(0, len(h), _PIECE):
        salted = _mixed(h[start:start + _PIECE] + _SALTS[:, None])
        votes += _bit_sums(np.ascontiguousarray(salted[VIEWS:].T).view(np.uint8))
        least = np.concatenate([least, salted[:VIEWS]], axis=1)
        if least.shape[1] > KEY_SHINGLES:
            least = np.partition(least, KEY_SHINGLES - 1, axis=1)[:, :KEY_SHINGLES]
    keys = [xxh64_intdigest(row.tobytes(), view) - 2**63 for view, row in enumerate(np.sort(least, axis=1))]
    return np.packbits(votes * 2 > len(h)).tobytes(), keys


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the first fingerprint of its group in its part; rows come ordered by part, which may span batches."""

    def of_part(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        prints = [r[2] for r in rows]
        own = groups([int.from_bytes(p) for p in prints], RADIUS)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array(prints, pa.binary()),
             pa.array([prints[i] for i in own], pa.binary())], ["shard", "a", "b"])

    held: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "wide"))):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    yield of_part(held)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([held[0][1]], pa.int64()), *[pa.array([held[0][2]], pa.binary())] * 2], ["shard", "a", "b"])
                held = []
            held.append(row)
    if held:
        yield of_part(held)


def _by_part(rows: DataFrame) -> DataFrame:
    """Rows ordered by ``part``, in as many tasks as the session shuffles to: few bytes cost much to compare, so
    adaptive execution must not merge them."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "wide")


def _in_trees(rows: DataFrame) -> DataFrame:
    return _by_part(rows.select("part", "shard", "wide")).mapInArrow(_grouped, "shard bigint, a binary, b binary")


def crossed(members: DataFrame) -> DataFrame:
    """``part``, ``chunk``, ``wide`` and ``root``: any two members of a ``group`` that differ in ``root`` meet in a part.

    ``weight`` is the share of a chunk that a member fills. The members of the group's largest root never meet each
    other; their chunks meet each chunk of the rest, and the chunks of the rest each other. A group of one root is done.
    """
    of_root = members.groupBy("group", "root").agg(F.sum("weight").alias("weight"))
    sizes = of_root.groupBy("group").agg(
        F.max_by("root", F.struct("weight", "root")).alias("core"), F.max("weight").alias("in_core"),
        F.sum("weight").alias("total"), F.count("*").alias("roots")).where("roots > 1")
    whole = lambda weight: F.greatest(F.lit(1), F.ceil(F.round(weight, 6)).cast("int"))
    sizes = sizes.select("group", "core", whole(F.col("in_core")).alias("n_core"),
                         whole(F.col("total") - F.col("in_core")).alias("n_rest"))
    placed = members.join(sizes, "group").withColumn("is_core", F.col("root") == F.col("core"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("wide", F.lit(-1)), F.when(F.col("is_core"), F.col("n_core")).otherwise(
        F.col("n_rest"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda kind, i, j: F.xxhash64("group", F.lit(kind), i, j)
    at = F.col("at")
    parts = F.when(F.col("is_core"), F.transform(up_to("n_rest"), lambda r: part(0, at, r))).otherwise(F.concat(
        F.transform(up_to("n_core"), lambda c: part(0, c, at)),
        F.transform(up_to("n_rest"), lambda r: part(1, F.least(at, r), F.greatest(at, r)))))
    chunk = (at * 2 + F.col("is_core").cast("int")).cast("bigint")
    return placed.select(F.explode(parts).alias("part"), chunk.alias("chunk"), "wide", "root")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the ``root`` of their component."""
    return members.join(roots.toDF("wide", "root"), "wide", "left").withColumn("root", F.coalesce("root", "wide"))


class _Open:
    """The rows of one part by place, and which of them are still to be compared: not of one label, and of different
    chunks unless the part is one chunk."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]]) -> None:
        self.prints = [r[2] for r in rows]
        self._bits = np.frombuffer(b"".join(self.prints), np.uint64).reshape(len(rows), -1)
        self._chunks = np.array([r[1] for r in rows], np.int64)
        self._one = bool((self._chunks == self._chunks[0]).all())
        numbers: dict[bytes, int] = {}
        self._labels = np.array([numbers.setdefault(r[3], len(numbers)) for r in rows], np.int64)

    def near(self, i: int) -> np.ndarray:
        """Places before ``i`` whose fingerprints are within the radius."""
        ok = self._labels[:i] != self._labels[i]
        if not self._one:
            ok &= self._chunks[:i] != self._chunks[i]
        at = np.flatnonzero(ok)
        return at[np.bitwise_count(self._bits[at] ^ self._bits[i]).sum(axis=1) <= RADIUS]

    def join(self, i: int, at: np.ndarray) -> list[int]:
        """Give ``at`` the label of ``i``; one place of each label that this joins."""
        if not len(at):
            return []
        labels, first = np.unique(self._labels[at], return_index=True)
        self._labels[np.isin(self._labels, labels)] = self._labels[i]
        return at[first].tolist()


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows ``(part, chunk, wide, root, ...)`` of each part; they come ordered by part, which may span batches."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "chunk", "wide", "root")]
        if "shingles" in batch.schema.names:
            sets = batch.column("shingles")
            columns.append([sets[i].values.to_numpy(zero_copy_only=False).copy() for i in range(len(sets))])
        for row in zip(*columns):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            if not held or held[-1][2] != row[2]:  # ordered by wide too; rows that come twice are one
                held.append(row)
    if held:
        yield held


def _edges(prints: list[bytes], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([prints[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


class _Overlaps:
    """Which sets of a part are similar to one of them, counted exactly."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self._sizes = np.array([len(x) for x in sets], np.int64)
        self._ends = np.cumsum(self._sizes)
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self._numbers, self._has = numbers, np.zeros(len(values), np.int32)

    def _own(self, i: int) -> np.ndarray:
        return self._numbers[self._ends[i] - self._sizes[i]:self._ends[i]]

    def similar(self, i: int, at: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` whose sets are similar to set ``i``."""
        num, den = SIMILARITY.numerator, SIMILARITY.denominator
        sums = self._sizes[at] + self._sizes[i]
        fits = np.minimum(self._sizes[at], self._sizes[i]) * (num + den) >= num * sums
        at, sums = at[fits], sums[fits]
        if not len(at):
            return at
        own = self._own(i)
        self._has[own] = 1
        if len(at) * 4 > len(self._sizes):
            shared = np.add.reduceat(self._has[self._numbers], self._ends - self._sizes)[at]
        else:
            shared = np.fromiter((self._has[self._own(j)].sum() for j in at.tolist()), np.int64, len(at))
        self._has[own] = 0
        return at[shared * (num + den) >= num * sums]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the labels of each part whose fingerprints are within the radius."""
    for rows in _parts_of(batches):
        opened = _Open(rows)
        yield _edges(opened.prints, [(i, j) for i in range(len(rows)) for j in opened.join(i, opened.near(i))])


def _contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part that have another one of it within the radius."""
    names = ["part", "chunk", "wide", "root"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for rows in _parts_of(batches):
        opened, hit = _Open(rows), np.zeros(len(rows), bool)
        for i in range(len(rows)):
            at = opened.near(i)
            hit[at] = True
            hit[i] |= len(at) > 0
        kept = [rows[i] for i in np.flatnonzero(hit).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate(types)], names)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the labels of each part whose sets are similar and fingerprints within the radius."""
    for rows in _parts_of(batches):
        opened, overlaps = _Open(rows), _Overlaps([r[4] for r in rows])
        yield _edges(opened.prints, [
            (i, j) for i in range(len(rows)) for j in opened.join(i, overlaps.similar(i, opened.near(i)))])


def wide_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: edges between distinct fingerprints ``wide`` that are filed in the shards ``keys``."""
    filed = stage(nodes.select("wide", F.explode("keys").alias("shard")), "wide_shards")
    rows, found, before, dealt = filed, None, None, None
    for k in range(ROUNDS):
        counts = rows.groupBy("shard").count()
        # a shard of one has nothing to link; a large one is dealt into chunks
        sizes = stage(counts.where(F.col("count") > 1), "wide_sizes")
        hot = sizes.where(F.col("count") > SHARD_LIMIT)
        total = hot.agg(F.sum("count")).first()[0] or 0
        dealt = hot if dealt is None else dealt
        apart = before is not None and total > 0.9 * before
        chunks = F.ceil(F.col("count") * 2 / SHARD_LIMIT)
        chunk = F.when(F.col("count") > SHARD_LIMIT, F.pmod(F.xxhash64("wide", F.lit(k)), chunks)).otherwise(F.lit(0))
        parts = rows.join(sizes, "shard").withColumn("part", F.xxhash64("shard", chunk))
        grouped = stage(_in_trees(parts), "wide_groups")
        links = grouped.where("a <> b").select("a", "b")
        found = links if found is None else found.union(links)
        if not total or apart:
            break
        before = total
        rows = grouped.where("a = b").join(hot, "shard", "left_semi").select(F.col("a").alias("wide"), "shard")
    if before is None:
        return found
    # all fingerprints of dealt shards, not those alone that stood for others, as far as components leave pairs open
    members = filed.join(dealt, "shard", "left_semi").select(
        F.col("shard").alias("group"), "wide", F.lit(2 / SHARD_LIMIT).alias("weight"))
    open_rows = crossed(stage(_rooted(members, components(found, "wide_roots")), "wide_members"))
    return found.union(_by_part(open_rows).mapInArrow(_close, "a binary, b binary"))


def are_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two arrays of distinct values have a similarity of ``SIMILARITY`` or more."""
    sizes, num, den = len(a) + len(b), SIMILARITY.numerator, SIMILARITY.denominator
    if min(len(a), len(b)) * (num + den) < num * sizes:  # even one within the other would not do
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) * (num + den) >= num * sizes


def similar_groups(prints: list[int], sets: list[np.ndarray]) -> list[int]:
    """For each set, the place of the first one of its group; pairs come from a BK-tree, nearest first."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree()  # prints are distinct, so nodes are numbered as they are
    for i, value in enumerate(prints):
        for j in sorted(tree.near(value, RADIUS), key=lambda j: (value ^ prints[j]).bit_count()):
            a, b = find(i), find(j)
            if a != b and are_similar(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
        tree.add(value)
    return [find(i) for i in range(len(prints))]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the first one of its group in its part; rows come ordered by part, which may span batches.

    The first of each group keeps its shingles if its part is one of several (``dealt``).
    """
    schema = pa.schema([("cluster", pa.int64()), ("a", pa.binary()), ("b", pa.binary()),
                        ("keys", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def of_part(rows: dict[bytes, tuple]) -> pa.RecordBatch:
        prints = list(rows)
        own = similar_groups([int.from_bytes(p) for p in prints], [r[2] for r in rows.values()])
        on = [r[3] and i == first for i, (first, r) in enumerate(zip(own, rows.values()))]
        columns = [[r[0] for r in rows.values()], prints, [prints[i] for i in own],
                   [r[1] if goes else None for goes, r in zip(on, rows.values())],
                   [r[2] if goes else None for goes, r in zip(on, rows.values())]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    part, held = None, {}
    for batch in batches:
        names = ("part", "cluster", "wide", "keys", "dealt")
        shingles = batch.column("shingles")
        for i, (at, cluster, wide, keys, dealt) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            if held and at != part:
                yield of_part(held)
                held = {}
            # a copy, so that a batch need not be kept for one of its rows; rows that come twice are one
            part = at
            if wide not in held:
                held[wide] = (cluster, keys, shingles[i].values.to_numpy(zero_copy_only=False).copy(), dealt)
    if held:
        yield of_part(held)


def _shingled(rows: DataFrame) -> DataFrame:
    """``cluster``, ``wide``, ``keys`` and ``shingles`` of the texts whose fingerprint is the ``node`` they are joined to."""

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        sets = [shingle_hashes(t) for t in as_bytes(batch.column("text"))]
        sketches = [sketch_of(h) for h in sets]
        return [[s[0] for s in sketches], [s[1] for s in sketches], [h.view(np.int64) for h in sets]]

    made = map_rows(rows, of_batch, "wide binary, keys array<bigint>, shingles array<bigint>")
    return made.where("wide = node").select("cluster", "wide", "keys", "shingles")


def similar_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``: edges between fingerprints of ``nodes`` whose texts have a similarity of 0.8 or more.

    ``nodes`` has each fingerprint ``wide`` once, with its shards ``keys`` and the ``doc_id`` of a text of ``docs``.
    """
    roots = components(wide_links(nodes), "wide_clusters").toDF("node", "root")
    clusters = roots.union(roots.select("root", "root").distinct()).select("node", F.xxhash64("root").alias("cluster"))
    members = nodes.select("doc_id", F.col("wide").alias("node")).join(clusters, "node")
    texts = stage(_shingled(docs.select("doc_id", "text").join(members, "doc_id")), "similar_texts")
    rows, found, before, dealt = texts, None, None, None
    while True:
        weighed = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
        chunks = F.greatest(F.ceil(F.col("n") / CLUSTER_LIMIT), F.ceil(F.col("total") / CLUSTER_SHINGLES))
        hot = stage(weighed.withColumn("chunks", chunks * 2).where("chunks > 2"), "hot_clusters")
        left = hot.agg(F.sum("n")).first()[0] or 0
        dealt = hot if dealt is None else dealt
        if before is not None and left > 0.75 * before:
            break
        placed = rows.join(hot.select("cluster", "chunks"), "cluster", "left")
        chunk = F.coalesce(F.pmod(F.xxhash64("wide", F.lit(left)), F.col("chunks")), F.lit(0))
        parts = placed.select("cluster", "wide", "keys", "shingles", F.col("chunks").isNotNull().alias("dealt"),
                              F.xxhash64("cluster", chunk).alias("part"))
        compared = stage(_by_part(parts).mapInArrow(
            _compared, "cluster bigint, a binary, b binary, keys array<bigint>, shingles array<bigint>"), "similar_groups")
        links = compared.where("a <> b").select("a", "b")
        found = links if found is None else found.union(links)
        if not left:
            break
        before = left
        rows = compared.where("shingles is not null").select("cluster", F.col("a").alias("wide"), "keys", "shingles")
    if before is None:
        return found
    # all texts of dealt clusters, not those alone that stood for others, as far as components leave pairs open
    members = texts.join(dealt.select("cluster"), "cluster", "left_semi").groupBy("cluster", "wide").agg(
        F.max(F.size("shingles")).alias("n")).select(F.col("cluster").alias("group"), "wide", F.greatest(
            F.lit(2 / CLUSTER_LIMIT), F.col("n") * 2 / CLUSTER_SHINGLES).alias("weight"))
    open_rows = crossed(stage(_rooted(members, components(found, "similar_roots")), "similar_members"))
    contested = stage(_by_part(open_rows).mapInArrow(
        _contested, "part bigint, chunk bigint, wide binary, root binary"), "similar_contested")
    full = _by_part(contested.join(texts.select("wide", "shingles"), "wide").select(
        "part", "chunk", "wide", "root", "shingles"))
    return found.union(full.mapInArrow(_similar, "a binary, b binary"))
