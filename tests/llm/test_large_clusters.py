"""Large groups: no link is lost between texts that were dealt into different chunks."""

import random

import numpy as np
from test_edited_copies import SCHEMA, edited, fresh, linked_groups

from panelcast.llm import wide_prints
from panelcast.llm.bktree import groups


def test_copies_that_only_their_original_links_are_one_group(spark):
    """700 copies of 0.84 to the original and about 0.72 to each other."""
    rng = random.Random(3)
    base = fresh(rng, 300)
    rows = [(0, " ".join(base)), *((i, " ".join(edited(rng, base, 5))) for i in range(1, 701))]
    assert set(linked_groups(spark.createDataFrame(rows, SCHEMA)).values()) == {0}


def test_large_shards_are_compared_in_full(spark, monkeypatch):
    """One shard of 300 scattered fingerprints, and of pairs and a star within the radius."""
    monkeypatch.setattr(wide_prints, "SHARD_LIMIT", 16)
    rng = random.Random(6)

    def near(value, bits):
        return value ^ sum(1 << b for b in rng.sample(range(256), bits))

    middle = rng.getrandbits(256)
    values = [middle, *(near(middle, 45) for _ in range(60))]
    for _ in range(60):
        values.append(rng.getrandbits(256))
        values += [near(values[-1], 50), rng.getrandbits(256), rng.getrandbits(256)]
    own = groups(values, wide_prints.RADIUS)
    place = {v.to_bytes(32): i for i, v in enumerate(values)}
    nodes = spark.createDataFrame([(bytearray(p), [1]) for p in place], "wide binary, keys array<bigint>")
    names = list(range(len(values)))
    for r in wide_prints.wide_links(nodes).collect():
        a, b = names[place[bytes(r.a)]], names[place[bytes(r.b)]]
        names = [min(a, b) if n in (a, b) else n for n in names]
    assert names == own and len(set(own)) == 181


def test_overlaps_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, 30).astype(np.uint64)) for _ in range(40)]
    overlaps = wide_prints._Overlaps(sets)
    for at in (np.arange(39), np.array([3, 17])):
        want = [j for j in at.tolist() if wide_prints.are_similar(sets[39], sets[j])]
        assert overlaps.similar(39, at).tolist() == want
