import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelcast.llm import lm
from panelcast.llm.lm import Model, Shard, Totals

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.fixture(scope="module")
def training(docs):
    rows = docs.collect()
    learned = [tokens(r.text) for r in rows if r.doc_id is not None and not held(r.doc_id)]
    return rows, learned


def key(row):
    return tuple((v is None, v if isinstance(v, (int, bool)) else 0) for v in row[:3])


@pytest.mark.parametrize("head_words", [lm.HEAD_WORDS, 5, 0])
def test_base_equals_brute_force(docs, training, monkeypatch, head_words):
    monkeypatch.setattr(Model.__init__, "__defaults__", (head_words, lm.SHARD_BYTES))
    rows, learned = training
    counts = Counter(w for t in learned for w in t)
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((r.doc_id, held(r.doc_id), len(t), sum(counts[w] > 0 for w in t), n, base))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.query(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_shards_and_one_filter_score_alike(docs, monkeypatch):
    """Many small segments, one shard each, give the scores of one filter."""
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", 256)
    texts, rows = docs.where("doc_id < 50"), docs.select("doc_id", "text")
    whole, parts = Model(texts), Model(texts, shard_bytes=1)
    assert len(whole.ranges) == 1 < len(parts.ranges)
    some = rows.where("doc_id in (3, 7, 100, 104, 115)")
    a = {(r.doc_id, r.n_tokens): r.score for r in lm.score(some, whole).collect()}
    parts.ranges = parts.ranges[:0] + [(lo, hi) for lo, hi in [(0, parts.segments // 2), (parts.segments // 2 + 1, parts.segments)]]
    b = {(r.doc_id, r.n_tokens): r.score for r in lm.score(some, parts).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_filter_never_undercounts_and_seldom_overcounts(training, docs):
    _, learned = training
    model = Model(docs.where("doc_id is not null"))
    shard = model.shard(0, model.segments)
    counts = Counter(w for r in docs.where("doc_id is not null").collect() for w in tokens(r.text))
    names = sorted(counts)
    grams = lm.mixed(np.array([xxh64_intdigest(w.encode()) for w in names], np.uint64))
    true = lm.levels(np.array([counts[w] for w in names]))
    got = shard.levels_of(grams)
    assert (got >= true).all() and (got > true).mean() < 0.1
    unseen = lm.mixed(np.array([xxh64_intdigest(f"unseen {i}".encode()) for i in range(5000)], np.uint64))
    assert (shard.levels_of(unseen) > 0).mean() < 0.1


def test_scores_are_those_of_the_smoothed_bigram_model(docs):
    """With the true levels in place of the filter's, by the definition."""
    text = "the cat saw the cat"
    t = tokens(text)
    one, pairs = Counter(t), Counter(zip(["", *t[:-1]], t))
    totals = Totals(sum(one.values()), len(one))
    level = lambda n: int(lm.levels(np.array([n]))[0])
    typical = lambda n: float(lm.typical(np.array([level(n)]))[0])
    want, before = 0.0, ""
    for w in t:
        own = (typical(one[w]) + 0.5) / (totals.tokens + 0.5 * (totals.distinct + 1))
        pair = min(typical(pairs[before, w]), typical(one[w]), typical(one[before]))
        want += math.log10((pair + lm.SMOOTHING * own) / (typical(one[before]) + lm.SMOOTHING))
        before = w
    first, second = (np.array([level(n) for n in c]) for c in (
        [one[w] for w in t], [pairs[p] for p in zip(["", *t[:-1]], t)]))
    got = lm.log_probabilities(first, second, np.array([0, len(t)]), level(one[""]), totals)
    assert got[0] == pytest.approx(want)


def test_levels_round_trip():
    n = np.arange(1, 5000)
    level = lm.levels(n)
    assert (np.diff(level) >= 0).all() and level[0] == 1
    assert (np.abs(lm.typical(level) / n - 1) < 0.5).all()
    assert lm.typical(np.array([0]))[0] == 0


def test_repeated_text_is_likelier_and_empty_cases(docs, clashing, empty):
    assert lm.query(empty).collect() == []
    rows = lm.query(docs).collect()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    ids = {r.doc_id: r for r in rows}
    assert ids[103].n_tokens == ids[104].n_tokens == ids[105].n_tokens == 1
    unlearned = lm.query(docs.where("doc_id is null")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and not r.held_out for r in unlearned)
    short = lambda df: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.query(df).collect())
    assert short(clashing) == short(docs)


def test_shard_ranges():
    assert lm.shard_ranges([(3, 80), (1, 80), (2, 800)], limit=20) == [(1, 1), (2, 2), (3, 3)]
    assert lm.shard_ranges([(0, 80), (1, 80), (5, 80)], limit=20) == [(0, 1), (5, 5)]
    assert lm.shard_ranges([]) == [(0, 0)]
    assert Shard.of([], 2).levels_of(np.array([1, 2], np.uint64)).tolist() == [0, 0]


def test_long_words_are_joined_and_not_in_the_head(spark):
    """However often they come; the base score is that of the definition all the same."""
    long, limit = "x" * (lm.HEAD_BYTES + 1), "é" * (lm.HEAD_BYTES // 2)
    texts = [f"{long} {limit} a", f"{long} {long} b", None, long.upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = Model(rows)
    assert set(model.head) == {b"a", b"b", limit.encode(), b""}
    counts = Counter(w for t in texts for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in lm.score(rows, model).collect():
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(t), len(t))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))


def test_rare_ngrams_can_stay_out_of_the_filter(docs):
    texts = docs.where("doc_id < 50")
    every, frequent = Model(texts), Model(texts, least_count=3)
    shard = frequent.shard(0, frequent.segments)
    size = lambda m: m.filter.selectExpr("sum(bits)").first()[0]
    assert size(frequent) < size(every)
    counts = Counter(w for r in texts.collect() for w in tokens(r.text))
    grams = lm.mixed(np.array([xxh64_intdigest(w.encode()) for w in sorted(counts)], np.uint64))
    n = np.array([counts[w] for w in sorted(counts)])
    level = shard.levels_of(grams)
    assert (level[n >= 3] >= lm.levels(n[n >= 3])).all() and (level[n < 3] > 0).mean() < 0.2
    assert Model(texts, least_count=10**9).shard(0, every.segments).levels_of(grams).sum() == 0
    assert all(math.isfinite(r.score) for r in lm.score(texts.select("doc_id", "text"), frequent).collect())


def test_segments_are_not_merged_into_one_task(spark):
    """However small they are here: at size a task's segments may reach Python in one Arrow batch."""
    texts = spark.createDataFrame([(f"word{k} follows word{k * 7 % 501} and then word{k * 3 % 499}",) for k in range(3000)], "text string")
    built = lm.segments_of(lm.gram_sums(texts, 64), 64)
    tasks = built.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 64 and len(tasks) > 64 // lm._TASK_SEGMENTS // 2
