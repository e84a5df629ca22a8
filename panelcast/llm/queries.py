"""The text operators over the whole given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import (
    decontaminate, langid, lexical, licenses, lm, merkle, mixing, ngram_quality, rule_ensemble, secret_scan, simhash,
    token_counts, urls,
)
from panelcast.llm.text import read


def on(table: str, query: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*[read(spark, sf_dir, name) for name in (table, *others)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": on("documents", rule_ensemble.query, "labels"),
    "op2_url_filters": on("pages", urls.query),
    "op3_curriculum_mix": on("documents", mixing.query),
    "op4_quality_rules": on("documents", ngram_quality.query, "labels"),
    "op5_license_scan": on("documents", licenses.query),
    "op6_lm_scoring": on("documents", lm.query),
    "op7_simhash_near_dedup": on("documents", simhash.query),
    "op8_secret_scan": on("documents", secret_scan.query),
    "op9_benchmark_decontamination": on("documents", decontaminate.query, "benchmark"),
    "op10_language_id": on("documents", langid.query),
    "op11_merkle_manifest": on("documents", merkle.query),
    "op12_token_counts": on("documents", token_counts.query),
    "op13_ranked_search": on("documents", lexical.query, "benchmark"),
}

ORACLE: dict[str, str] = {
    "op2_url_filters": urls.SQL,
    "op3_curriculum_mix": mixing.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_ranked_search": lexical.SQL,
}
