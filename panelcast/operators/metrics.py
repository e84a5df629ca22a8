"""Accuracy metrics in natural space, unweighted, from one pass over the scored steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.operators.losses import by_model, weighted_mse
from panelcast.spec import METRIC_EPS, PanelSpec


def error_terms(p: Column, t: Column, spec: PanelSpec) -> dict[str, Column]:
    """Per-step terms whose means are metrics.

    The likelihood is for targets in [0, 1] and null for rates; mape is for rates with a target
    above zero and null otherwise.
    """
    error = p - t
    null = F.lit(None).cast("double")
    if spec.is_rate:
        likelihood = null
        mape = F.when(F.abs(t) > METRIC_EPS, F.abs(error / F.nullif(t + METRIC_EPS, F.lit(0.0))))
    else:
        pc, tc = targets.clip01(p, METRIC_EPS), targets.clip01(t, METRIC_EPS)
        likelihood = F.ln(pc) * tc + F.ln(1.0 - pc) * (1.0 - tc)
        mape = null
    return {
        "mse": error * error,
        "mae": F.abs(error),
        "smape": 100.0 * 2.0 * F.abs(error) / (F.abs(p) + F.abs(t) + METRIC_EPS),
        "bias": error,
        "log_likelihood": likelihood,
        "mape": 100.0 * mape,
    }


def metrics_record(rows: DataFrame, models: list[str], by: list[str], spec: PanelSpec) -> DataFrame:
    """mse, rmse, mae, r2, smape, bias, log_likelihood, mape and the mean batch loss per group.

    Rows carry ``batch_id``. Sums are taken per batch and rolled up, so the rows are read once for
    both the metrics and the batch means. A constant target scores r2 1 if matched exactly, else 0,
    and fewer than two steps have none.
    """
    p, t = targets.inverse(F.col("yhat"), spec), targets.inverse(F.col("y"), spec)
    terms = error_terms(F.col("p"), F.col("t"), spec)
    batches = (
        by_model(rows, models).select(*by, "batch_id", "y", "yhat", "w", p.alias("p"), t.alias("t"))
        .groupBy(*by, "batch_id")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(f"{name}_sum") for name, c in terms.items()],
            F.count(terms["mape"]).alias("mape_n"),
            F.avg("t").alias("t_mean"),
            F.var_pop("t").alias("t_var"),
            F.min("t").alias("t_min"),
            F.max("t").alias("t_max"),
            weighted_mse(F.col("yhat") - F.col("y"), F.col("w")).alias("level_loss"),
        )
    )
    n, mean = F.col("n"), F.col("t_mean")
    total = F.sum(n)
    between = F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / total
    spread = F.sum(n * F.col("t_var")) + F.greatest(between, F.lit(0.0))
    squares = F.sum("mse_sum")
    r2 = (
        F.when(total < 2, None)
        .when(F.min("t_min") < F.max("t_max"), 1.0 - squares / F.nullif(spread, F.lit(0.0)))
        .otherwise(F.when(squares == 0, 1.0).otherwise(0.0))
    )

    def mean_of(name: str) -> Column:
        return F.sum(f"{name}_sum") / total

    return batches.groupBy(*by).agg(
        total.alias("n"),
        mean_of("mse").alias("mse"),
        F.sqrt(mean_of("mse")).alias("rmse"),
        mean_of("mae").alias("mae"),
        r2.alias("r2"),
        mean_of("smape").alias("smape"),
        mean_of("bias").alias("bias"),
        mean_of("log_likelihood").alias("log_likelihood"),
        (F.sum("mape_sum") / F.nullif(F.sum("mape_n"), F.lit(0))).alias("mape"),
        F.avg("level_loss").alias("avg_loss_transformed"),
    )


def compare_models(records: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model; a model without a record gives nulls.

    Two records of one model are an error, found when the table is read.
    """
    names = ["mse", "rmse", "mae", "r2"]
    long = records.unpivot(["model"], names, "metric", "value")
    once = F.when(F.count(F.lit(1)) <= 1, F.max("value")).otherwise(
        F.raise_error(F.lit("two records of one model")).cast("double"))
    return long.groupBy("metric").pivot("model", models).agg(once)
