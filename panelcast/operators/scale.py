"""Standardisation of covariates with statistics of the training series only."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.outline import one_per_series
from panelcast.spec import PanelSpec


def fit_scaler(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row of means and population standard deviations; one vote per training series.

    A column that is constant up to rounding gets deviation 1, so scaling only centres it.
    """
    train = one_per_series(series).filter(F.col("split") == "train")
    stats = []
    for c in spec.statics:
        value = F.col(f"fit_statics.{c}").cast("double")
        mean, var, n = F.avg(value), F.var_pop(value), F.count(value)
        rounding = n * F.lit(sys.float_info.epsilon)
        noise = rounding * var + F.pow(rounding * mean, F.lit(2.0))
        stats.append(mean.alias(f"mean_{c}"))
        stats.append(F.when(var <= noise, 1.0).otherwise(F.stddev_pop(value)).alias(f"std_{c}"))
    return train.agg(*stats)


def scaler_value(scaler: DataFrame) -> Column:
    """The one scaler row as a scalar subquery: no join, and more than one row is an error."""
    return scaler.select(F.struct("*")).scalar()
