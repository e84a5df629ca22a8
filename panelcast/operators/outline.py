"""Per-series facts, kept on one row per chunk of a series.

Everything a row needs to know about its whole series (length, mean, first covariates, offsets of
its chunk) is computed here from one partial aggregate over the staged windows. Later joins bring
it to the rows by (parameter, simulation, chunk), which stays even when one series is huge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.windows import attach_statics, missing_statics
from panelcast.spec import PanelSpec


def chunk_outline(windows: DataFrame, spec: PanelSpec, statics: DataFrame | None = None) -> DataFrame:
    """Add series-level columns to each chunk; the window below runs over chunks, not rows.

    ``statics`` supplies, by parameter, the covariates that the windows do not carry.
    """
    missing = missing_statics(windows, spec)
    held = [c for c in spec.statics if c not in missing]
    y = F.col(spec.target)
    valid_rank = F.when(F.col("is_valid"), F.col("in_chunk"))
    leads = F.col("in_chunk") == 1
    leads_valid = F.col("is_valid") & (F.col("valid_in_chunk") == 1)
    chunks = windows.groupBy(*spec.pair, "chunk").agg(
        F.count("*").alias("n"),
        F.count(valid_rank).alias("n_valid"),
        F.sum(F.when(~F.isnan(y), y)).alias("y_sum"),
        F.count(F.when(~F.isnan(y), y)).alias("y_count"),
        # one row of a chunk leads it; plain maxima of numbers stay in a hash aggregate
        *[F.max(F.when(leads, F.col(c))).alias(f"first_{c}") for c in held],
        *[F.max(F.when(leads_valid, F.col(c))).alias(f"valid_{c}") for c in held],
        F.min(valid_rank).alias("valid_from"),
        F.max(valid_rank).alias("valid_to"),
        F.max_by(y, valid_rank).alias("last_y"),
        F.max_by(spec.global_id, "in_chunk").alias("last_global"),
    )
    series = Window.partitionBy(*spec.pair)
    earlier = series.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str):
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    offset = chunks.withColumn("rows_before", before("n")).withColumn("valid_before", before("n_valid"))

    def of_leading_chunk(leading, prefix: str):
        return [F.max(F.when(leading, F.col(f"{prefix}_{c}"))).over(series).alias(f"{prefix}_{c}") for c in held]

    first = F.col("rows_before") == 0
    first_valid = (F.col("valid_before") == 0) & (F.col("n_valid") > 0)
    whole = offset.select(
        *spec.pair,
        "chunk",
        "rows_before",
        "valid_before",
        "n_valid",
        first.alias("is_first"),
        F.sum("n").over(series).alias("length"),
        F.sum("n_valid").over(series).alias("valid_length"),
        (F.sum("y_sum").over(series) / F.nullif(F.sum("y_count").over(series), F.lit(0))).alias("mean_target"),
        F.min(F.col("rows_before") + F.col("valid_from")).over(series).alias("min_step"),
        F.max(F.col("rows_before") + F.col("valid_to")).over(series).alias("max_step"),
        *of_leading_chunk(first, "first"),
        *of_leading_chunk(first_valid, "valid"),
        F.max_by("last_global", "chunk").over(series).alias(spec.global_id),
        F.last("last_y", ignorenulls=True).over(earlier).alias("y_before"),
    )

    def packed(prefix: str):
        return F.struct(*[F.col(c if c in missing else f"{prefix}_{c}").alias(c) for c in spec.statics])

    return (
        attach_statics(whole, statics, missing, spec)
        .withColumn("fit_statics", packed("first"))
        .withColumn("statics", packed("valid"))
        .drop(*missing, *[f"{p}_{c}" for p in ("first", "valid") for c in held])
    )


def above_threshold(outline: DataFrame, spec: PanelSpec) -> DataFrame:
    """Series whose unweighted mean over windows reaches the threshold."""
    return outline.filter(F.col("mean_target") >= spec.threshold)


def one_per_series(outline: DataFrame) -> DataFrame:
    return outline.filter("is_first")
