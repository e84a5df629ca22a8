"""Two simple forecasts, used to score and to compare models with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.spec import DAYS_PER_YEAR, PanelSpec

SEASON_DAYS = 28
BASELINES = ["persistence", "seasonal"]


def season_of(day: str):
    return F.floor((F.col(day) % DAYS_PER_YEAR) / SEASON_DAYS).cast("bigint")


def season_means(features: DataFrame) -> DataFrame:
    """Mean transformed training target per season of the year that any row falls in; at most 14 rows.

    A season without training rows takes the mean over all training rows.
    """
    y = F.when(F.col("split") == "train", F.col("y"))
    sums = features.groupBy(season_of("abs_timesteps").alias("season")).agg(
        F.sum(y).alias("y_sum"), F.count(y).alias("y_count")
    )
    every = Window.partitionBy()
    overall = F.sum("y_sum").over(every) / F.nullif(F.sum("y_count").over(every), F.lit(0))
    mean = F.col("y_sum") / F.nullif(F.col("y_count"), F.lit(0))
    return sums.select("season", F.coalesce(mean, overall).alias("season_mean"))


def predict_baselines(features: DataFrame, spec: PanelSpec, learned: DataFrame | None = None) -> DataFrame:
    """Add both baselines' forecasts, ``yhat_persistence`` and ``yhat_seasonal``; no shuffle.

    Persistence repeats the previous step's target (``previous_y`` in the chunk, ``y_before`` over a chunk
    border) and falls back to the season where there is none. Seasons are learned from ``learned`` where
    ``features`` are only some of the rows.
    """
    means = season_means(features if learned is None else learned)
    before = F.coalesce("previous_y", "y_before")
    return (
        features.withColumn("season", season_of("abs_timesteps"))
        .join(F.broadcast(means), "season")  # at most 14 rows
        .withColumn("yhat_persistence", F.coalesce(targets.transform(before, spec), F.col("season_mean")))
        .withColumn("yhat_seasonal", F.col("season_mean"))
        .drop("season", "season_mean", "previous_y", "y_before")
    )
