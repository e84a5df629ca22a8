"""Edited copies: sketches from the definition, recall against brute force, and hot shards."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import simhash, wide_prints

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def fresh(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, tokens, edits):
    out = list(tokens)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """60 originals of 200 words with copies of 1 to 4 changed words, half-shared documents, and clean ones."""
    rng = random.Random(5)
    texts = []
    for k in range(60):
        base = fresh(rng, 200)
        texts += [base, edited(rng, base, 1 + k % 4)]
        if k % 3 == 0:
            texts.append(base[:100] + fresh(rng, 100))  # shares half of its text
    texts += [fresh(rng, 150) for _ in range(60)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute_groups(rows, least):
    names = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and similarity(a, b) >= least:
                old, new = names[i], names[j]
                names = {k: min(new, old) if v in (old, new) else v for k, v in names.items()}
    return names


def test_shingles_follow_the_definition():
    text = "A b C d e f a b c d e f"
    assert len(wide_prints.shingle_hashes(text.encode())) == len(shingles(text))
    assert wide_prints.sketch(text.encode()) == wide_prints.sketch(text.lower().encode())
    assert wide_prints.sketch(None) == wide_prints.sketch(b" \n") == (bytes(32), [])
    assert len(wide_prints.shingle_hashes(b"only three words")) == 1


def test_order_of_words_matters():
    h = wide_prints.shingle_hashes
    assert not np.intersect1d(h(b"a b c d e"), h(b"b a c d e")).size


def nodes_of(docs):
    prints = simhash.wide_fingerprints(docs)
    return prints.groupBy("wide").agg(F.min("doc_id").alias("doc_id"), F.min("keys").alias("keys")).cache()


def linked_groups(docs):
    """The least ``doc_id`` of each document's group, by the links alone."""
    nodes = nodes_of(docs)
    ids = {bytes(r.wide): r.doc_id for r in nodes.collect()}
    names = {i: i for i in ids.values()}
    for r in wide_prints.similar_links(docs, nodes).collect():
        a, b = names[ids[bytes(r.a)]], names[ids[bytes(r.b)]]
        names = {k: min(a, b) if v in (a, b) else v for k, v in names.items()}
    return names


def test_links_are_those_of_brute_force(spark, corpus):
    assert linked_groups(spark.createDataFrame(corpus, SCHEMA)) == brute_groups(corpus, 0.8)


def test_pairs_near_the_threshold(spark):
    """200 pairs of similarities from 0.7 to 0.9: nothing below 0.8 is linked, and at most one in a hundred above is missed."""
    rng = random.Random(11)
    rows = []
    for k in range(200):
        base = fresh(rng, 250)
        at = rng.randrange(180)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:at] + fresh(rng, 14 + k % 31) + base[at + 14 + k % 31:]))]
    want, got = brute_groups_of_pairs(rows), linked_groups(spark.createDataFrame(rows, SCHEMA))
    found = {i for i in want if got[i] != i}
    assert found <= {i for i, linked in want.items() if linked}
    assert 40 <= sum(want.values()) <= 160
    assert len(found) >= 0.99 * sum(want.values())


def brute_groups_of_pairs(rows):
    return {i: similarity(rows[i - 1][1], text) >= 0.8 for i, text in rows if i % 2}


def test_similarity_is_exact():
    sets = np.arange(0, 9), np.arange(1, 10), np.arange(1, 11), np.arange(0, 0)
    assert wide_prints.are_similar(sets[0], sets[1])  # 8 of 10
    assert not wide_prints.are_similar(sets[0], sets[2])  # 8 of 11
    assert not wide_prints.are_similar(sets[0], sets[3])


def test_edited_copies_go_and_clean_documents_stay(spark, corpus):
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(corpus, SCHEMA), edited=True).collect()}
    strict = brute_groups(corpus, 0.8)
    assert len({i for i, name in strict.items() if name != i}) >= 45
    assert kept == {i for i, name in strict.items() if name == i}


def test_large_clusters_are_dealt_and_compared_by_shard(spark, monkeypatch):
    monkeypatch.setattr(wide_prints, "CLUSTER_LIMIT", 8)
    monkeypatch.setattr(wide_prints, "CLUSTER_SHINGLES", 4000)
    rng = random.Random(8)
    base = fresh(rng, 300)
    copies = [(i, " ".join(edited(rng, base, 1))) for i in range(100)]
    # pairs of one cluster: any two pairs have about 0.6 in common, the two of a pair 0.95
    pairs = []
    for k in range(40):
        own = base[:220] + fresh(rng, 80)
        pairs += [(200 + 2 * k, " ".join(own)), (201 + 2 * k, " ".join(edited(rng, own, 1)))]
    got = linked_groups(spark.createDataFrame([*copies, *pairs], SCHEMA))
    assert {got[i] for i, _ in copies} == {0}
    assert {i: got[i] for i, _ in pairs} == {i: i - i % 2 for i, _ in pairs}


def test_hot_shards_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(wide_prints, "SHARD_LIMIT", 16)
    rng = random.Random(8)
    base = fresh(rng, 300)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)] + [(1000, " ".join(fresh(rng, 300)))]
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA), edited=True).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1000]


def test_awkward_rows(spark, docs, clashing, empty):
    assert simhash.keep_first(empty, edited=True).collect() == []
    same = lambda df: Counter(map(tuple, df.collect()))
    kept = simhash.keep_first(clashing, edited=True)
    assert kept.columns == clashing.columns
    assert same(kept.select(docs.columns)) == same(simhash.keep_first(docs, edited=True))
    assert set(map(tuple, simhash.keep_first(docs, edited=True).collect())) <= set(map(tuple, simhash.keep_first(docs).collect()))
