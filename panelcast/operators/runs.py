"""Training runs as tables: early stopping, best epochs, best trials, which parameters to use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ordinals import total_within


def patience_counter(history: DataFrame, run: list[str]) -> DataFrame:
    """Add the best loss so far, whether the epoch improved on it, and epochs since the last gain.

    An epoch improves if its loss is below infinity and below all earlier losses, of which those that are not
    numbers do not count. Before the first gain every epoch counts. ``history`` holds one row per run and epoch.
    """
    by_epoch = Window.partitionBy(*run).orderBy("epoch")
    earlier = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_epoch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.when(~F.isnan("val_loss"), F.col("val_loss"))
    best_before = F.coalesce(F.min(number).over(earlier), F.lit(float("inf")))
    improved = F.coalesce(number < best_before, F.lit(False))
    rows = history.withColumn("improved", improved).withColumn(
        "epoch_number", F.row_number().over(by_epoch).cast("bigint")
    )
    last_gain = F.max(F.when(F.col("improved"), F.col("epoch_number"))).over(so_far)
    best = F.min(F.when(F.col("improved"), F.col("val_loss"))).over(so_far)
    return rows.withColumn("best_so_far", best).withColumn(
        "patience_counter", F.col("epoch_number") - F.coalesce(last_gain, F.lit(0))
    )


def run_report(history: DataFrame, run: list[str], patience: int) -> DataFrame:
    """Per run: stop epoch, whether it stopped early, and the best epoch up to the stop, null if none improved."""
    counted = patience_counter(history, run)
    limit = F.min(F.when(F.col("patience_counter") >= patience, F.col("epoch")))
    stops = counted.withColumn("_stop", limit.over(Window.partitionBy(*run)))
    seen = stops.filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return seen.groupBy(*run).agg(
        F.max("epoch").alias("stop_epoch"),
        F.max(F.col("_stop").isNotNull()).alias("stopped_early"),
        F.min("best_so_far").alias("best_val_loss"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
    )


def best_epoch(history: DataFrame, run: list[str]) -> DataFrame:
    """Epoch of lowest loss, the earliest on a tie."""
    return history.groupBy(*run).agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
    )


def leaderboard(trials: DataFrame) -> DataFrame:
    """Rank of each trial within its model, lowest loss first; failed trials (inf) come last.

    There are few models and perhaps very many trials, so the rank is not taken in one task per model.
    """
    ranked = total_within(trials, "model_type", ["best_val_loss", "trial_number"], F.lit(1), "_earlier")
    return ranked.withColumn("rank", F.col("_earlier") + 1).drop("_earlier")


def best_trial(trials: DataFrame) -> DataFrame:
    """The lowest loss per model, the earliest trial on a tie; one aggregate, no sort."""
    best = F.min_by(F.struct(*trials.columns), F.struct("best_val_loss", "trial_number"))
    return trials.groupBy("model_type").agg(best.alias("best")).select("best.*")


def choose_parameters(defaults: DataFrame, loaded: DataFrame, tuned: DataFrame,
                      parameters: list[str]) -> DataFrame:
    """Per model: tuned parameters if there are any, else loaded ones, else the defaults.

    A parameter set is taken whole, never mixed from two sources.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("model_type", F.struct(F.lit(name).alias("source"), *parameters).alias(name))

    return (
        packed(defaults, "default")
        .join(packed(loaded, "loaded"), "model_type", "left")
        .join(packed(tuned, "tuned"), "model_type", "left")
        .select("model_type", F.coalesce("tuned", "loaded", "default").alias("chosen"))
        .select("model_type", "chosen.*")
    )
