"""The fact table: one row per parameter set, simulation and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.by_series import CHUNK, layout_of
from panelcast.spec import PanelSpec


def read_facts(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    """Scan a Parquet fact table, only the columns the mode needs."""
    return select_facts(spark.read.parquet(path), spec)


def read_fact_table(spark: SparkSession, table: str, spec: PanelSpec) -> DataFrame:
    """Scan a catalog table in the same way; one written by series keeps its buckets."""
    return select_facts(spark.read.table(table), spec)


def select_facts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keys, day, the mode's two counts as doubles, and whichever covariates the table holds.

    Facts kept by series keep their chunk too.
    """
    held = [c for c in spec.statics if c in df.columns]
    if layout_of(df, spec) is not None:
        held.append(CHUNK)
    return df.select(
        *spec.unit,
        spec.day,
        F.col(spec.num).cast("double").alias(spec.num),
        F.col(spec.den).cast("double").alias(spec.den),
        *held,
    )
