"""Connected components by alternating star contractions, each a join and an aggregate on the edges.

Edges go towards smaller nodes until every component is one star, which one aggregate a round tells. All state stays in
tables, written after each half of a round, so that plans stay small; the driver sees three numbers a round. Nodes with
very many neighbours are not brought together (see ``with_least``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.stage import stage, unstage

#: A key with more rows is a hub, but the limit rises with the rows, so that there are ``MOST_HUBS`` hubs at most.
HOT = 1_000
MOST_HUBS = 10_000
#: Parts that operators deal the rows of a hub into.
SALTS = 64


def _limit(rows: int, largest: int, limit: int | None = None) -> int:
    limit = max(HOT if limit is None else limit, rows // MOST_HUBS)
    return limit if largest > limit else 0


def is_hot(rows: DataFrame, key: str, limit: int | None = None) -> int:
    """The number of rows above which a key is a hub; 0 if none is."""
    total, largest = rows.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    return _limit(total or 0, largest or 0, limit)


def with_least(rows: DataFrame, key: str, value: str, name: str, hot: int) -> DataFrame:
    """Add the least ``value`` of each row's key as ``name``.

    Keys with more than ``hot`` rows are few, so their least values go to the rows where these are; the rows of all other
    keys are joined by key. With a ``hot`` of 0 no key is a hub.
    """
    if not hot:
        return rows.join(rows.groupBy(key).agg(F.min(value).alias(name)), key)
    least = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_rows"))
    hubs = F.broadcast(least.where(F.col("_rows") > int(hot)).drop("_rows"))
    others = rows.join(hubs.select(key), key, "left_anti")
    return rows.join(hubs, key).unionByName(others.join(least.where(F.col("_rows") <= int(hot)).drop("_rows"), key))


def _ends(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """``(a, b)``: a row for each of the ``ends`` of each edge, from one reading."""
    each = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends)))
    return edges.select(each.alias("at")).select("at.a", "at.b")


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    found = with_least(_ends(edges, ("a", "b"), ("b", "a")), "a", "b", "least", hot).where("b > a")
    return found.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them; edges run from ``a`` down to ``b``."""
    found = with_least(edges, "a", "b", "least", hot)
    return _ends(found, ("b", "least"), ("a", "least")).where("a <> b").distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether distinct edges, which run from ``a`` down to ``b``, are stars around the least nodes: each node has one edge
    down and none up, or none down. And the number of neighbours above which a node is a hub, 0 if none is."""
    nodes = _ends(edges, ("a", "b"), ("b", "a")).groupBy("a").agg(
        F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("down"))
    off = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("n") > F.col("down")))
    total, largest, some = nodes.agg(F.sum("n"), F.max("n"), F.count_if(off)).first()
    return not some, _limit(total or 0, largest or 0)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(a, b)``: every node that is not the least of its component, with the least one.

    ``edges`` has two columns of one orderable type; direction, repeats and loops do not matter.
    """
    a, b = (F.col(c) for c in edges.columns)
    current = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    done, hot = _shape(current)
    while not done:
        linked = stage(_large_star(current, hot), name)
        following = stage(_small_star(linked, hot), name)  # a node never gets more neighbours within a round
        done, hot = _shape(following)  # reads it, so that what is cached is there before its sources go
        unstage(linked)
        unstage(current)
        current = following
    return current
