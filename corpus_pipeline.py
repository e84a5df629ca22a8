"""A corpus pipeline: identify languages, drop near-duplicates and benchmark leaks, mask secrets, and mix.

Each stage takes what its predecessor kept, is written as Parquet and read again. All but the last return
the columns of ``documents`` as they came. Null ids, texts, languages and sources, empty texts, repeated
rows and empty tables are treated as the operators say; a document of null text has no language and goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import decontaminate, langid, mixing, secret_scan, simhash
from panelcast.llm.text import read
from panelcast.sources.stage import staged_result, unstage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are written in a learned language."""
    return langid.keep_identified(docs, langid.fit(langid.learned_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (edited copies too), the one with the least ``doc_id``."""
    return simhash.keep_first(docs, edited=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents once per pass that takes them, sorted by position."""
    return mixing.training_stream(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("curriculum_mix", mix_sources),
]

#: Fingerprints, learned profiles and token counts have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        kept = staged_result(spark, name, lambda docs=docs, function=function: function(spark, docs, sf_dir))
        if k and kept.staged_path is not None:
            unstage(docs)
        docs = kept
    return docs
