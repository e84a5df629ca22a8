"""Tables behind the reports: which series to show, and truth beside every model's prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.operators.losses import forecast_of
from panelcast.operators.outline import one_per_series
from panelcast.operators.sampling import seeded_order
from panelcast.operators.split import distinct_params
from panelcast.spec import PanelSpec

SHOWN_PARAMS = 9


def report_params(outline: DataFrame, spec: PanelSpec, count: int = SHOWN_PARAMS) -> DataFrame:
    """Up to nine test parameters in seeded order."""
    test = distinct_params(outline.filter(F.col("split") == "test"), spec)
    order = seeded_order(spec, spec.param, salt="report")
    return test.orderBy(order, spec.param).limit(count)


def report_series(windows: DataFrame, test_series: DataFrame, params: DataFrame, spec: PanelSpec) -> DataFrame:
    """One series per chosen parameter: its first test simulation, else its first simulation.

    ``windows`` may hold series outside every split, such as those under the threshold; ``params``
    is a short list from ``report_params``.
    """
    present = windows.join(F.broadcast(params), spec.param, "left_semi").select(*spec.pair).distinct()
    flagged = flag_test(present, test_series, spec)
    first_test = F.min(F.when(F.col("is_test"), F.col(spec.sim)))
    return flagged.groupBy(spec.param).agg(
        F.coalesce(first_test, F.min(spec.sim)).alias(spec.sim), first_test.isNotNull().alias("is_test")
    )


def flag_test(rows: DataFrame, test_series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add whether the row's series belongs to the test split."""
    tests = test_series.select(*spec.pair).distinct().withColumn("is_test", F.lit(True))
    return rows.join(tests, spec.pair, "left").withColumn(
        "is_test", F.coalesce("is_test", F.lit(False))
    )


def test_series(outline: DataFrame, spec: PanelSpec) -> DataFrame:
    return one_per_series(outline).filter(F.col("split") == "test").select(*spec.pair)


def actual_vs_predicted(rows: DataFrame, models: list[str], spec: PanelSpec) -> DataFrame:
    """One row per (series, step) with the truth and a ``<model>_prediction`` column per model; a projection.

    Values are in natural space; rates are shown by day, prevalence by step.
    """
    return rows.select(
        *spec.unit,
        (F.col("split") == "test").alias("is_test"),
        F.col("abs_timesteps" if spec.is_rate else "timesteps").alias("timestep"),
        targets.inverse(F.col("y"), spec).alias(f"true_{spec.target}"),
        *[targets.inverse(F.col(forecast_of(m)), spec).alias(f"{m}_prediction") for m in models],
    )
