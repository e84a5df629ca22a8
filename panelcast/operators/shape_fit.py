"""A linear forecaster fitted on the loss that is reported: level, slope and curvature inside look-back windows.

The loss over all training windows is a sum of squares of the errors and of their first and second differences. A step,
a pair or a triple of steps counts as often as windows hold it, so no window is made: each series is differenced once, in
runs of bounded size, and one aggregate brings the sums of products of the three orders to the driver.

In natural space the forecast is the inverse transform of a linear one. There the training steps are staged once, in buckets
of runs, so that no later pass shuffles them, and the fit goes in rounds of two passes: one
linearises the forecasts around the present weights and takes the same sums, from which steps of several lengths are solved; the
other takes the true loss of them all side by side, and the lowest is the next round's start.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.operators.normal import ONE, TARGET, LinearForecast, least_squares, product_sums
from panelcast.operators.sequences import coverage
from panelcast.sources.stage import Layout, stage, unstage
from panelcast.spec import PanelSpec

ORDERS = (0, 1, 2)
ROUNDS = 10
#: Added to the diagonal, as a share of it: from the full step to a short one down the slope.
DAMPING = (0.0, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 1e2, 1e3)


def in_runs(rows: DataFrame, most: int, spec: PanelSpec) -> DataFrame:
    """Steps in runs of bounded size, which also get the last ``most`` steps before them, so a long series is spread over many tasks.

    ``_held_<k>`` tells how many training windows hold a step and the k before it.
    """
    rows = rows.withColumns({f"_held_{k}": coverage(spec, k) for k in range(most + 1)})
    if not most:
        return rows.withColumn("_own", F.lit(0)).withColumn("_run", F.lit(0))
    size = max(spec.chunk, spec.lookback)
    own = F.floor(F.col("position") / size).cast("bigint")
    ends = F.col("position") % size >= size - most
    return rows.withColumn("_own", own).withColumn(
        "_run", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))


def staged_runs(train: DataFrame, spec: PanelSpec) -> DataFrame:
    """The steps of ``in_runs`` that a fit reads, staged in buckets of runs: passes over them difference them without a shuffle."""
    steps = train.filter(F.col("valid_length") >= spec.lookback).select(
        *spec.pair, "position", "valid_length", *spec.feature_columns, "y", "w")
    buckets = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = in_runs(steps, max(shares(spec)), spec).drop("valid_length")
    return stage(runs, "fit_runs", Layout(buckets, (*spec.pair, "_run")))


def differenced_steps(rows: DataFrame, columns: list[str], orders: list[int], spec: PanelSpec) -> DataFrame:
    """``order``, ``fit_weight`` and the columns, differenced that often, of each step that training windows hold.

    ``rows`` are steps, or steps that are in runs already.
    """
    most = max(orders)
    rows = rows if "_run" in rows.columns else in_runs(rows, most, spec)
    step = Window.partitionBy(*spec.pair, "_run").orderBy("position")

    def lagged(column: str, by: int) -> Column:
        return F.lag(column, by).over(step) if by else F.col(column)

    lags = [lagged(c, k).alias(f"_{c}_{k}") for c in (*columns, "w") for k in range(most + 1)]
    lagging = rows.select("_own", "_run", *[f"_held_{k}" for k in orders], *lags)

    def difference(column: str, order: int, signs: int = -1) -> Column:
        terms = [F.lit(float(math.comb(order, k) * signs ** k)) * F.col(f"_{column}_{k}") for k in range(order + 1)]
        return sum(terms[1:], terms[0])

    each = [
        F.struct(
            F.lit(order).alias("order"),
            (F.col(f"_held_{order}") * difference("w", order, 1) / 2 ** order).alias("fit_weight"),
            *[difference(c, order).alias(c) for c in columns],
        )
        for order in orders
    ]
    return lagging.filter("_own = _run").select(F.inline(F.array(*each))).filter("fit_weight > 0")


def slope_of_inverse(y: Column, spec: PanelSpec) -> Column:
    """Derivative of the inverse target transform."""
    if spec.is_rate:
        return F.exp(y)
    p = targets.sigmoid(y)
    return p * (1.0 - p)


def linearised(train: DataFrame, model: LinearForecast | None, spec: PanelSpec) -> DataFrame:
    """The steps with the inputs and the target of a linear fit: as they are, or around a model in natural space."""
    if model is None:
        return train.withColumns({ONE: F.lit(1.0), TARGET: F.col("y")})
    at = train.withColumn("_eta", model.value())
    slope = slope_of_inverse(F.col("_eta"), spec)
    truth, now = targets.inverse(F.col("y"), spec), targets.inverse(F.col("_eta"), spec)
    inputs = {c: F.col("_slope") * F.col(c) for c in spec.feature_columns}
    return at.withColumn("_slope", slope).withColumns(
        {ONE: F.col("_slope"), TARGET: truth - now + F.col("_slope") * F.col("_eta"), **inputs})


def shares(spec: PanelSpec) -> dict[int, float]:
    """Weight of each order's term in the loss, for the orders that have one."""
    weights = {0: 1.0, 1: spec.slope_weight, 2: spec.curvature_weight}
    return {order: weights[order] for order in ORDERS if weights[order] or not order}


def loss_sums(train: DataFrame, model: LinearForecast | None, spec: PanelSpec) -> np.ndarray:
    """Sums of products of the whole loss: its three terms by their weights, each over its total weight, at least 1."""
    share = shares(spec)
    columns = [ONE, *spec.feature_columns, TARGET]
    steps = differenced_steps(linearised(train, model, spec), columns, list(share), spec).withColumn("_unit", F.lit(1.0))
    found = product_sums(steps, [*columns, "_unit"], "fit_weight", ["order"])
    if (0,) not in found:
        raise ValueError(f"no training series reaches the look-back length {spec.lookback}")
    return sum(share[order] / max(sums[-1, -1], 1.0) * sums[:-1, :-1] for (order,), sums in found.items())


def natural_losses(train: DataFrame, models: list[LinearForecast], spec: PanelSpec) -> list[float]:
    """The loss in natural space of several models, from one pass."""
    share, errors = shares(spec), [f"_error{k}" for k in range(len(models))]
    missed = {e: targets.inverse(m.value(), spec) - targets.inverse(F.col("y"), spec) for e, m in zip(errors, models)}
    steps = differenced_steps(train.withColumns(missed), errors, list(share), spec)
    total = F.greatest(F.sum("fit_weight"), F.lit(1.0))
    found = steps.groupBy("order").agg(*[(F.sum(F.col("fit_weight") * F.col(e) * F.col(e)) / total).alias(e) for e in errors]).collect()
    losses = [sum(share[row["order"]] * row[e] for row in found) for e in errors]
    return [x if math.isfinite(x) else math.inf for x in losses]


def damped_steps(sums: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Weights after a step of each length towards the minimum of the linearised loss."""
    a, slope = sums[:-1, :-1], sums[:-1, -1] - sums[:-1, :-1] @ weights
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    scaled = a / np.outer(scale, scale)
    return [weights + np.linalg.lstsq(scaled + d * np.eye(len(scale)), slope / scale, rcond=1e-12)[0] / scale for d in DAMPING]


def fit_shape(features: DataFrame, spec: PanelSpec, rounds: int = ROUNDS, tolerance: float = 1e-9) -> LinearForecast:
    """Fit the training split of staged features on level, slope and curvature in ``spec.loss_space``.

    In transformed space the minimum takes one pass. In natural space at most ``rounds`` rounds follow, until one
    lowers the loss by no more than ``tolerance`` of itself; a round never raises it. The whole split counts as one batch.
    """
    train = features.filter(F.col("split") == "train")
    if spec.loss_space != "natural":
        return LinearForecast(spec.feature_columns, least_squares(loss_sums(train, None, spec)))
    runs = staged_runs(train, spec)
    try:
        return _rounds(runs, spec, rounds, tolerance)
    finally:
        unstage(runs)


def _rounds(train: DataFrame, spec: PanelSpec, rounds: int, tolerance: float) -> LinearForecast:
    inputs = spec.feature_columns
    best = LinearForecast(inputs, least_squares(loss_sums(train, None, spec)))
    lowest = natural_losses(train, [best], spec)[0]
    for _ in range(rounds):
        steps = damped_steps(loss_sums(train, best, spec), best.weights)
        tried = [LinearForecast(inputs, w) for w in steps if np.isfinite(w).all()]
        if not tried:
            break
        losses = natural_losses(train, tried, spec)
        k = int(np.argmin(losses))
        if not losses[k] < lowest:
            break
        gain, best, lowest = lowest - losses[k], tried[k], losses[k]
        if gain <= tolerance * lowest:
            break
    return best
