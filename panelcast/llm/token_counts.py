"""Token counts of documents for a public tokenizer, of whole texts and of every prefix.

``with_prefix_counts`` stores the count at every prefix of a text, which answers how many tokens its first
characters have (``tokens_of_first``) and how much of it fits a budget (``fitting``) without encoding it again.
``truncate`` cuts texts to a budget. Special strings of the vocabulary inside a text are one token each, as the
library has it by default. The vocabulary file (2 MB) is read by the driver and broadcast; a worker remembers a
bounded number of pieces and pairs of tokens.

Defined results: null text is empty and has no tokens, and stays null when cut; repeated rows come back as often
as they came in; columns that an operator adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.prefix_bpe import PrefixCounter, longest_prefix
from panelcast.llm.text import map_rows

VOCABULARY = path("byte_bpe_50k.json")
LIMIT = 512

_counters: dict[str, PrefixCounter] = {}


def counter(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[], PrefixCounter]:
    """A function that gives a worker its counter, built once per vocabulary from the broadcast file."""
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    name, shared = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)

    def get() -> PrefixCounter:
        if name not in _counters:
            _counters.clear()
            _counters[name] = PrefixCounter(shared.value)
        return _counters[name]

    return get


def with_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``n_tokens`` of the whole ``text``."""
    get = counter(docs.sparkSession, vocabulary)

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        count = get().count
        return [[count(t) for t in batch.column("text").to_pylist()]]

    return map_rows(docs.drop("n_tokens"), of_batch, "n_tokens bigint")


def with_prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``prefix_tokens``: entry i, from 0, is the number of tokens of the first i characters of ``text``."""
    get = counter(docs.sparkSession, vocabulary)

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        counts = get().prefix_counts
        return [[counts(t) for t in batch.column("text").to_pylist()]]

    return map_rows(docs.drop("prefix_tokens"), of_batch, "prefix_tokens array<int>")


def tokens_of_first(n_chars: Column | int, counts: str = "prefix_tokens") -> Column:
    """Tokens of the first ``n_chars`` characters, or of the whole text where it is shorter."""
    n_chars = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(counts, F.least(n_chars.cast("int") + 1, F.size(counts)))


def fitting(budget: Column | int, counts: str = "prefix_tokens") -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens; a longer prefix may have fewer tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    within = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.coalesce(F.array_max(within), F.lit(0))


def truncate(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Cut ``text`` to its longest prefix of at most ``limit`` tokens and add the ``n_tokens`` that are left."""
    get = counter(docs.sparkSession, vocabulary)
    columns = [c for c in docs.columns if c != "n_tokens"]

    def of_batch(batch: pa.RecordBatch) -> list[list]:
        tokens, texts = get(), []
        for text in batch.column("_text").to_pylist():
            counts = tokens.prefix_counts(text)
            kept = longest_prefix(counts, limit)
            texts.append((text if text is None else text[:kept], counts[kept]))
        return [[t for t, _ in texts], [n for _, n in texts]]

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    cut = map_rows(packed, of_batch, "_cut string, _n bigint")
    return cut.select(*[(F.col("_cut") if c == "text" else F.col("_row")[c]).alias(c) for c in columns],
                      F.col("_n").alias("n_tokens"))


def query(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    counted = with_counts(docs.select("doc_id", "text"), vocabulary)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
