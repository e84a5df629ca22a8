"""Counts at every prefix against the library itself, and the DataFrame functions over awkward rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import token_counts
from panelcast.llm.prefix_bpe import PrefixCounter, longest_prefix

PARTS = [
    "a", "b", "the", " the", "ing", " ", "  ", "    ", "\n", " \n ", "\t", "\r\n", "'", "'re", "'ll", "'s", "don't", "12", "0",
    "!", "?!", "_", "---", "é", "日本", "　", "\x85", "\xa0", "\x1c", "\0", "̈", "\U0001f600", "꟎", "՘",
    "<|endoftext|>", "<|end", "oftext|>", "XX", "zqx",
]


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.VOCABULARY, encoding="utf-8") as file:
        return PrefixCounter(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(token_counts.VOCABULARY)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=12))
def test_every_prefix_equals_the_library(counter, library, parts):
    text = "".join(parts)
    counts = counter.prefix_counts(text)
    assert counts == [library(text[:i]) for i in range(len(text) + 1)]
    assert counter.count(text) == counts[-1]
    for budget in range(len(counts)):
        assert longest_prefix(counts, budget) == max(i for i, n in enumerate(counts) if n <= budget)


@pytest.mark.parametrize("text", ["a" * 5_000, "\n" * 5_000, " " * 5_000 + "x", "ab" * 3_000, "é" * 2_000, "0123456789" * 500])
def test_long_runs(counter, library, text):
    assert counter.count(text) == library(text) == counter.prefix_counts(text)[-1]


def test_random_letters(counter, library):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aeinorst h") for _ in range(40))
        assert counter.count(text) == library(text)


def test_what_is_remembered_is_bounded(counter, monkeypatch):
    monkeypatch.setattr("panelcast.llm.prefix_bpe.REMEMBERED", 50)
    expected = {i: counter.count(f"word{i}x") for i in range(300)}
    assert all(counter.count(f"word{i}x") == n for i, n in expected.items())
    assert len(counter.pieces) <= 50


def test_other_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        PrefixCounter(file.read())


def test_query(docs, clashing, empty, library):
    def wanted(rows):
        return Counter((r.doc_id, len((r.text or "").encode()), n := library(r.text or ""), n > 512) for r in rows)

    got = token_counts.query(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert Counter(map(tuple, rows)) == wanted(docs.collect())
    assert any(r.over_limit for r in rows) and not all(r.over_limit for r in rows)
    assert Counter(map(tuple, token_counts.query(clashing).collect())) == wanted(clashing.collect())
    assert token_counts.query(empty).collect() == []


def test_stored_counts_answer_budgets(docs, library):
    small = docs.where("length(text) < 700 or text is null").withColumn("prefix_tokens", F.lit("own"))
    stored = token_counts.with_prefix_counts(small)
    for row in stored.select("text", token_counts.tokens_of_first(17).alias("first"),
                             token_counts.fitting(9).alias("fits"), token_counts.fitting(0).alias("none")).collect():
        text = row.text or ""
        assert row.first == library(text[:17]) and row.none == 0
        assert row.fits == max(i for i in range(len(text) + 1) if library(text[:i]) <= 9)


def test_truncate(clashing, library):
    rows = clashing.withColumn("n_tokens", F.lit(1)).withColumn("_text", F.lit("own")).withColumn("_row", F.lit("own"))
    cut = token_counts.truncate(rows, 20)
    assert sorted(cut.columns) == sorted(rows.columns)
    cut = cut.collect()
    assert len(cut) == clashing.count()
    for row in cut:
        assert row["_row"] == row["_text"] == row["score"] == "own"
        assert row["n_tokens"] == library(row["text"] or "") <= 20
    assert any(row["text"] is None for row in cut)
