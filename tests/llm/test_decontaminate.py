import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.llm import decontaminate
from panelcast.llm.wumanber import WuManber

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(doc_rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = Counter()
    for r in doc_rows:
        w, hit, found = words(r.text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= owners - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[r.doc_id, len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


@pytest.mark.parametrize("pack_words", [1 << 20, 12])
def test_query_equals_brute_force(docs, benchmark, monkeypatch, pack_words):
    monkeypatch.setattr(decontaminate.find_hits, "__defaults__", (pack_words,))
    got = Counter(map(tuple, decontaminate.query(docs, benchmark).collect()))
    want = plain(docs.collect(), [tuple(r) for r in benchmark.collect()])
    assert got == want
    assert sum(n for row, n in want.items() if row[5]) >= 4


def test_empty_tables_and_clashing_names(docs, clashing, empty, benchmark):
    nothing = benchmark.limit(0)
    assert decontaminate.query(empty, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.query(docs, nothing).collect())
    same = lambda df: Counter(map(tuple, df.collect()))
    assert same(decontaminate.query(clashing, benchmark)) == same(decontaminate.query(docs, benchmark))


@pytest.mark.parametrize("pack_words", [1 << 20, 12])
def test_stage_drops_exactly_the_contaminated(clashing, benchmark, pack_words):
    kept = decontaminate.keep_clean(clashing, benchmark, pack_words)
    assert kept.columns == clashing.columns
    bad = {r.doc_id for r in decontaminate.query(clashing, benchmark).collect() if r.contaminated}
    assert bad >= {108, 109, 110, 111}
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in clashing.collect() if r.doc_id not in bad)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.lists(st.lists(st.sampled_from("abc"), min_size=5, max_size=5), max_size=6),
       st.lists(st.sampled_from("abcd"), max_size=40))
def test_search_finds_every_occurrence(length, patterns, text):
    patterns = {tuple(p[:length]): (i,) for i, p in enumerate(patterns)}
    found = WuManber(patterns, length).search(text)
    want = {(i, patterns[tuple(text[i:i + length])]) for i in range(len(text) - length + 1)
            if tuple(text[i:i + length]) in patterns}
    assert len(found) == len(set(found)) and set(found) == want


def test_item_ids_are_texts(spark, docs):
    items = spark.createDataFrame([("item-10", "short item here"), ("item-9", "short item here"), (None, "short item here")],
                                  "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate.query(docs, items).collect()}
    want = hashlib.sha256(b"item-10,item-9").hexdigest()
    assert rows[110].n_items == 2 and rows[110].items_sha256 == want


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 60), st.integers(1, 12))
def test_pieces_have_the_windows_of_the_whole(n, length):
    tokens = [b"%d" % i for i in range(n)]
    windows = lambda w: [tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))]
    parts = decontaminate.cut(tokens, length)
    assert [x for p in parts for x in windows(p)] == windows(tokens)
    assert all(len(p) <= length + 9 for p in parts)


def test_long_items_are_searched_in_packs(spark):
    text = " ".join(f"w{i}" for i in range(45_000))
    items = spark.createDataFrame([("long", text), ("other", "one two")], "item_id string, text string")
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{j}" for j in range(at, at + 10))) for i, at in enumerate([0, 9_995, 10_000, 29_991, 44_990, 44_991])],
        "doc_id bigint, text string")
    assert len(list(decontaminate.packs(items, 12_000))) == 4
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.find_hits(docs, items, 12_000).select(
        "doc_id", F.size("places").alias("n_hit"), "items").collect()}
    assert got == {**{i: (10, ["long"]) for i in range(5)}, 5: (0, [])}
