"""Days into fixed windows as ratios of sums, and gap-free step numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.sampling import sampled
from panelcast.sources.by_series import CHUNK, layout_of
from panelcast.sources.stage import stage
from panelcast.spec import PanelSpec

PER = 1000.0


def ratio(num: Column, den: Column) -> Column:
    """Null, not an error, where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def row_rate(facts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rate per 1000 of each single day, null without exposure."""
    rate = ratio(F.lit(PER) * F.col(spec.num).cast("double"), F.col(spec.den).cast("double"))
    return facts.withColumn("raw_cases", rate)


def assign_windows(facts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Drop the burn-in and number the tumbling windows from its end."""
    day = F.col(spec.day)
    return facts.filter(day >= spec.burn_in).withColumn(
        "group_id", F.floor((day - spec.burn_in) / spec.window).cast("bigint")
    )


def window_sums(facts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Target, first day and covariates of each (unit, window); one map-side combined aggregate.

    Facts kept by series are summed in their buckets, and the windows keep the chunk.
    """
    total = F.sum(F.col(spec.num).cast("double"))
    exposure = F.sum(F.col(spec.den).cast("double"))
    if spec.is_rate:
        target = [
            ratio(F.lit(PER) * total, exposure).alias(spec.target),
            total.alias("cases_count"),
            exposure.alias("exposure_pd"),
        ]
    else:
        target = [ratio(total, exposure).alias(spec.target)]
    held = [c for c in spec.statics if c in facts.columns]
    chunk = [] if layout_of(facts, spec) is None else [CHUNK]  # follows from the window
    return (
        assign_windows(facts, spec)
        .groupBy(*spec.unit, *chunk, "group_id")
        .agg(
            F.min(spec.day).alias("abs_timesteps"),
            *target,
            *[F.max(c).alias(c) for c in held],
        )
    )


def panel_windows(facts: DataFrame, spec: PanelSpec, population: DataFrame | None = None) -> DataFrame:
    """Window rows with a target, for the sampled series, with the covariates the facts hold."""
    windows = window_sums(sampled(facts, spec, population), spec)
    return windows.filter(F.col(spec.target).isNotNull())


def missing_statics(df: DataFrame, spec: PanelSpec) -> list[str]:
    return [c for c in spec.statics if c not in df.columns]


def attach_statics(df: DataFrame, statics: DataFrame | None, missing: list[str], spec: PanelSpec) -> DataFrame:
    """Add covariates kept in a table by parameter; several rows of one parameter give their maximum.

    Done on aggregated rows or, in the pipeline, on one row per chunk of a series, never on facts.
    """
    if not missing:
        return df
    if statics is None:
        raise ValueError(f"covariates {missing} are neither in the fact table nor in a statics table")
    one_each = statics.groupBy(spec.param).agg(*[F.max(c).alias(c) for c in missing])
    return df.join(one_each, spec.param, "left")


def is_finite(column: str | Column) -> Column:
    y = F.col(column) if isinstance(column, str) else column
    return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != F.lit(float("inf")))


def number_in_chunks(windows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rank rows inside chunks of consecutive windows, so that a long series is spread over tasks.

    ``in_chunk`` counts all rows from 1, ``valid_in_chunk`` those with a finite target, and ``previous_y`` is
    the last finite target before the row in its chunk.
    """
    order = Window.partitionBy(*spec.pair, "chunk").orderBy("group_id", spec.global_id)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    if layout_of(windows, spec) is None:
        windows = windows.withColumn(CHUNK, F.floor(F.col("group_id") / spec.chunk).cast("bigint"))
    return windows.withColumn("is_valid", is_finite(spec.target)).select(
        "*",
        F.row_number().over(order).cast("bigint").alias("in_chunk"),
        F.sum(F.col("is_valid").cast("bigint")).over(so_far).alias("valid_in_chunk"),
        F.last(F.when(F.col("is_valid"), F.col(spec.target)), ignorenulls=True).over(earlier).alias("previous_y"),
    )


def stage_windows(facts: DataFrame, spec: PanelSpec, population: DataFrame | None = None) -> DataFrame:
    """The window rows, numbered within chunks and written once; every later pass reads them.

    Series are sampled from ``population`` where the facts were already cut, say by date.
    """
    rows = number_in_chunks(panel_windows(facts, spec, population), spec)
    return stage(rows, "windows", layout_of(rows, spec))


def with_steps(windows: DataFrame, outline: DataFrame, spec: PanelSpec) -> DataFrame:
    """Gap-free step number 1..T per series: rank in the chunk plus the rows of earlier chunks."""
    offsets = outline.select(*spec.pair, "chunk", "rows_before")
    return (
        windows.join(offsets, [*spec.pair, "chunk"])
        .withColumn("timesteps", F.col("rows_before") + F.col("in_chunk"))
        .drop("rows_before")
    )
