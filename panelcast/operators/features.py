"""Model inputs, target and weight of every step, as one projection over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import calendar, targets
from panelcast.operators.scale import scaler_value
from panelcast.sources.stage import unsent
from panelcast.spec import PanelSpec


def gated(covariate: str, value: Column, day: Column, spec: PanelSpec) -> Column:
    """Raw covariate, hidden as zero before the intervention if it is a gated one."""
    value = value.cast("double")
    return F.when(calendar.is_after(day, spec), value).otherwise(0.0) if covariate in spec.gated else value


def scaled(covariate: str, value: Column, day: Column, scaler: Column, spec: PanelSpec) -> Column:
    """Gate first, then scale: a hidden value becomes (0 - mean) / std, not zero."""
    raw = gated(covariate, value, day, spec)
    return (raw - scaler[f"mean_{covariate}"]) / scaler[f"std_{covariate}"]


def join_outline(windows: DataFrame, outline: DataFrame, spec: PanelSpec) -> DataFrame:
    """Valid rows of the kept series with their series-level columns, steps and positions.

    ``timesteps`` is the gap-free step 1..T over all windows, ``position`` counts valid rows from 0.
    The join key includes the chunk, so rows of one long series go to many tasks. Many rows are not sent to every task.
    """
    key = [*spec.pair, "chunk"]
    rows = windows.filter("is_valid").select(
        *key, "in_chunk", "valid_in_chunk", "abs_timesteps", "previous_y", *spec.measures
    )
    return (
        unsent(rows).join(outline.drop("is_first", "n_valid", "length", "mean_target", "fit_statics"), key)
        .withColumn("timesteps", F.col("rows_before") + F.col("in_chunk"))
        .withColumn("position", F.col("valid_before") + F.col("valid_in_chunk") - 1)
        .drop("rows_before", "valid_before", "in_chunk", "valid_in_chunk")
    )


def row_weight(spec: PanelSpec) -> Column:
    return F.col("exposure_pd") if spec.is_rate else F.lit(1.0)


def panel_features(windows: DataFrame, outline: DataFrame, scaler: DataFrame, spec: PanelSpec,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys, step, features in model order, transformed target ``y`` and weight ``w``.

    ``outline`` must hold the kept series with their split label; ``carry`` names further columns of
    the windows or the outline to keep.
    """
    rows = join_outline(windows, outline, spec)
    day, stats = F.col("abs_timesteps"), scaler_value(scaler)
    if spec.cyclic_time:
        angle = calendar.day_angle(day)
        time = {"sin_day": F.sin(angle), "cos_day": F.cos(angle)}
    else:
        time = {"time_norm": calendar.time_norm(F.col("timesteps"), F.col("min_step"), F.col("max_step"))}
    features = time | {
        f"scaled_{c}": scaled(c, F.col(f"statics.{c}"), day, stats, spec) for c in spec.statics
    }
    features["post_intervention"] = calendar.post_intervention(day, spec)
    features["years_since"] = calendar.years_since(day, spec)
    return rows.select(
        *spec.unit,
        "chunk",
        "split",
        "timesteps",
        "abs_timesteps",
        "position",
        "valid_length",
        *[features[name].alias(name) for name in spec.feature_columns],
        targets.transform(F.col(spec.target), spec).alias("y"),
        row_weight(spec).cast("double").alias("w"),
        *carry,
    )
