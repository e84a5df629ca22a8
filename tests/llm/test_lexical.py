"""Search by intervals against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import interval_search, lexical
from panelcast.llm.interval_search import Best, Segment

WORDS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def plain(docs, items, best=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counts = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        wanted, scores = set(terms_of(text)), []
        for doc_id, c, n in counts:
            m = 10 + 90 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best], 1)]
    return Counter(out)


def found(spark, docs, items, **options):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    return Counter(map(tuple, lexical.search(documents, spark.createDataFrame(items, "item_id bigint, text string"), **options).collect()))


@settings(max_examples=200, deadline=None)
@given(
    lists=st.lists(st.dictionaries(st.integers(0, 25), st.integers(0, 4), max_size=20), min_size=1, max_size=6),
    wanted=st.sets(st.integers(0, 7), max_size=6), size=st.integers(1, 4), batch=st.integers(1, 5),
)
def test_segment_finds_the_best(lists, wanted, size, batch):
    keys = np.arange(26) // 2 * 3  # equal keys too
    flat = [(t, d, x) for t, docs in enumerate(lists) for d, x in docs.items()]
    columns = np.array(flat, np.int64).reshape(-1, 3).T
    best, old = Best(size), interval_search.BATCH
    interval_search.BATCH = batch
    try:
        segment = Segment(keys, *columns)
        scored = segment.search(np.array(sorted(wanted), np.int64), best)
    finally:
        interval_search.BATCH = old
    scores = Counter()
    for t, d, x in flat:
        scores[d] += x * (t in wanted)
    want = sorted((-s, int(keys[d])) for d, s in scores.items() if s > 0)[:size]
    got = [(-s, k) for s, k in zip(best.scores.tolist(), best.keys.tolist()) if s > 0]
    assert got == want and scored <= 26


def test_most_documents_are_never_scored():
    rng = np.random.default_rng(1)
    terms, docs = rng.integers(0, 50, 40_000), rng.integers(0, 4_000, 40_000)
    pairs = np.unique(np.stack([terms, docs]), axis=1)
    impacts = rng.integers(1, 100, pairs.shape[1]) * np.where(pairs[1] % 400 == 0, 50, 1)
    best = Best(10)
    scored = Segment(np.arange(4_000), pairs[0], pairs[1], impacts).search(np.arange(5), best)
    assert len(best.scores) == 10 and scored < 1_000


@pytest.mark.parametrize("pack_bytes", [lexical.PACK_BYTES, 20_000])
def test_equals_scoring_everything(spark, docs, benchmark, pack_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()] + [(20 + i, rows[i][1]) for i in range(0, 40, 4)]
    got = found(spark, rows, items, pack_bytes=pack_bytes)
    assert got == plain(rows, items) and sum(got.values()) > 30
    assert max(got.values()) > 1  # items given twice


def test_ties_and_many_segments(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of fox dog cat é 7 Über").upper() if rng.random() < 0.3 else
                      rng.choice(["the", "of", "fox", "dog", "cat", "é", "7", "Über", f"w{rng.randint(0, 40)}"])
                      for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [(rng.randint(0, 500), rng.choice(texts)) for _ in range(700)] + [(None, texts[0])] * 30
    items = [(k, text) for k, text in enumerate([*texts[:12], "the", "w1 w2 w3", "nothing-here", ""])]
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 64)
    monkeypatch.setattr(lexical, "SALTS", 3)
    assert found(spark, rows, items) == plain(rows, items)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = ("Alpha é-beta 12x_" * 50 + "tail").encode()
    whole = lexical.term_counts(text, {b"alpha": 0, b"beta": 1, "é".encode(): 2, b"12x": 3, b"tail": 4})
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(lexical, "PART_BYTES", size)
        again = lexical.term_counts(text, {b"alpha": 0, b"beta": 1, "é".encode(): 2, b"12x": 3, b"tail": 4})
        assert again[0] == whole[0] == 201 and dict(zip(*again[1:])) == dict(zip(*whole[1:]))


def test_empty_tables_and_clashing_columns(spark, docs, clashing, empty, benchmark):
    no_items = spark.createDataFrame([], "item_id string, text string")
    assert lexical.query(empty, benchmark).collect() == []
    nothing = lexical.query(docs, no_items)
    assert nothing.collect() == [] and nothing.columns == ["item_id", "rank", "doc_id", "score"]
    own = clashing.selectExpr("*", "'own' m", "'own' terms", "'own' counts", "'own' item", "'own' item_id")
    assert Counter(map(tuple, lexical.query(own, benchmark).collect())) == Counter(map(tuple, lexical.query(clashing, benchmark).collect()))
    named = spark.createDataFrame([("item-1", "alpha beta gamma")], "item_id string, text string")
    assert {r.item_id for r in lexical.query(docs, named).collect()} == {"item-1"}
