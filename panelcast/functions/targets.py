"""Target transforms and their inverses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec


def clip01(x: Column, eps: float) -> Column:
    """Into [eps, 1 - eps]; null stays null, which ``greatest`` and ``least`` would not keep."""
    low, high = eps, 1.0 - eps
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def logit(x: Column, eps: float) -> Column:
    clipped = clip01(x, eps)
    return F.ln(clipped / (1.0 - clipped))


def sigmoid(y: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-y))


def log1p_floor(x: Column) -> Column:
    return F.log1p(F.when(x < 0.0, 0.0).otherwise(x))


def transform(x: Column, spec: PanelSpec) -> Column:
    """Natural to training space."""
    x = x.cast("double")
    return log1p_floor(x) if spec.is_rate else logit(x, spec.eps)


def inverse(y: Column, spec: PanelSpec) -> Column:
    """Training space to natural."""
    return F.expm1(y) if spec.is_rate else sigmoid(y)
