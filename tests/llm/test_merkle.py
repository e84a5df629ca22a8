"""The manifest against a plain version that builds the trees in lists."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from panelcast.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root, and for each leaf its steps up as (left siblings, right siblings)."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for way, i in zip(ways, at):
            first = i - i % 3
            way.append((level[first:i], level[i + 1:first + 3]))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], ways


def plain(rows):
    sources = {}
    for doc_id, source, lang, n_chars, text in rows:
        own = h(*map(part, (doc_id, source, lang, n_chars, text)))
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        seen = text.replace("\n", "") if even and text is not None else text
        key = (source is not None, (source or "").encode())
        sources.setdefault(key, []).append((doc_id, own, h(*map(part, (doc_id, source, lang, n_chars, seen)))))
    order = sorted(sources)
    for key in order:
        sources[key].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subtrees = {key: tree([own for _, own, _ in sources[key]]) for key in order}
    root, above = tree([subtrees[key][0] for key in order])
    out = []
    for key, up in zip(order, above):
        subroot, ways = subtrees[key]
        for (doc_id, own, seen), way in zip(sources[key], ways):
            folded = seen
            for left, right in [*way, *up]:
                folded = h(*left, folded, *right)
            proof = h(*(d for left, right in [*way, *up] for d in [*left, *right]))
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return out


def found(df):
    return Counter(map(tuple, merkle.query(df).collect()))


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 4, 9, 10, 28, 81]])
def test_small_trees(spark, sizes):
    rows = [(s * 1000 + i, f"s{s}", "en", i, f"text {i}\n{s}") for s, size in enumerate(sizes) for i in range(size)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == Counter(plain(rows))


def test_trees_of_many_blocks(spark):
    sizes = [merkle.WIDTH - 1, merkle.WIDTH, merkle.WIDTH + 1, 3 * merkle.WIDTH + 2]
    rows = [(i, f"s{n}", None, None, f"line {i}\nend") for n in sizes for i in range(n)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == Counter(plain(rows))
    assert {r[6] for r in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"source {i % 800}", "en", 1, None if i % 5 else "x\n") for i in range(1_700)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == Counter(plain(rows))


def test_awkward_rows(docs, clashing, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert found(docs) == Counter(plain(rows))
    own = clashing.withColumns({c: F.lit("own") for c in ("group", "idx", "block", "path", "top", "_row", "digest", "n")})
    assert found(own) == Counter(plain(rows))
    assert merkle.query(empty).collect() == []


def test_one_key_with_all_rows(spark):
    """Rows alike in every column, and rows without an id: each has a leaf of its own."""
    rows = [(None, None, None, None, None)] * 400 + [(7, None, "en", 3, "a\nb")] * 500 + [(None, "s", "en", 3, "a\nb")] * 300
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == Counter(plain(rows))


def test_blocks_are_spread(spark):
    """A source with all rows is hashed in many tasks: windows are dealt by source and block."""
    rows = [(i, "one", "en", 1, str(i)) for i in range(3 * merkle.WIDTH)]
    plan = merkle.query(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in plan and "block" in plan and "Python" not in plan and "Arrow" not in plan
