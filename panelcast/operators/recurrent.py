"""Forecasters with state along the series: linear recurrences by an associative scan of affine maps.

A state moves by ``h = a * h_before + b``. Such maps compose into one map, in any grouping, so the maps of a chunk of a
series are composed by doubling (lags of 1, 2, 4, ... rows), the chunks' maps likewise on one row per chunk, and a step's state
is its map within the chunk applied to the state before the chunk. No task ever holds more of a series than a chunk, or
than its one row per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.normal import ONE, TARGET, LinearForecast, penalised, product_sums
from panelcast.operators.sequences import coverage
from panelcast.spec import PanelSpec

#: Share of a state that is left a step later.
DECAYS = (0.5, 0.9)


def composed(rows: DataFrame, maps: list[str], by: list[str], order: str, most: int) -> DataFrame:
    """Replace each row's maps by the composition of all of its group's up to it; a group has at most ``most`` rows.

    The map ``name`` is held in the columns ``<name>_a`` and ``<name>_b``.
    """
    in_order = Window.partitionBy(*by).orderBy(order)
    width = 1
    while width < most:
        lags = [F.lag(f"{m}_{part}", width).over(in_order).alias(f"_{m}_{part}") for m in maps for part in "ab"]
        near = rows.select("*", *lags)
        rows = near.withColumns({
            **{f"{m}_b": F.col(f"{m}_b") + F.coalesce(F.col(f"{m}_a") * F.col(f"_{m}_b"), F.lit(0.0)) for m in maps},
            **{f"{m}_a": F.col(f"{m}_a") * F.coalesce(F.col(f"_{m}_a"), F.lit(1.0)) for m in maps},
        }).drop(*[f"_{m}_{part}" for m in maps for part in "ab"])
        width *= 2
    return rows


def scanned(rows: DataFrame, states: dict[str, tuple[Column | float, Column]], spec: PanelSpec) -> DataFrame:
    """Add each state of each step: its factor times the state one step before, plus its input; before a series it is zero.

    ``rows`` are steps with ``chunk`` and ``position``. A null input counts as zero.
    """
    key, names = [*spec.pair, "chunk"], list(states)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    per_series = sizes.groupBy(*spec.pair).agg(F.max("n").alias("n"), F.count("*").alias("chunks"))
    most, chunks = per_series.agg(F.max("n"), F.max("chunks")).first()
    maps = rows
    for name, (factor, drive) in states.items():
        factor = F.lit(float(factor)) if isinstance(factor, (int, float)) else factor
        maps = maps.withColumns({f"{name}_a": factor.cast("double"), f"{name}_b": F.coalesce(drive.cast("double"), F.lit(0.0))})
    local = composed(maps, names, key, "position", most or 1)
    last = [F.max_by(f"{m}_{part}", "position").alias(f"{m}_{part}") for m in names for part in "ab"]
    whole = composed(local.groupBy(*key).agg(*last), names, spec.pair, "chunk", chunks or 1)
    series = Window.partitionBy(*spec.pair).orderBy("chunk")
    before = whole.select(*key, *[F.coalesce(F.lag(f"{m}_b").over(series), F.lit(0.0)).alias(f"_{m}_before") for m in names])
    here = {m: F.col(f"{m}_a") * F.col(f"_{m}_before") + F.col(f"{m}_b") for m in names}
    return local.join(before, key).select(*rows.columns, *[c.alias(m) for m, c in here.items()])


def state_name(column: str, decay: float) -> str:
    return f"{column}_h{round(decay * 1000)}"


def with_states(features: DataFrame, inputs: list[str], decays: tuple[float, ...], spec: PanelSpec) -> DataFrame:
    """Add a decaying sum of each input for each decay; at a decay of ``d`` its weight falls by ``d`` a step."""
    return scanned(features, {state_name(c, d): (d, F.col(c)) for c in inputs for d in decays}, spec)


@dataclass
class StatefulForecast:
    """A linear read-out of the inputs and of their states, used like a fitted model on whole series."""

    inputs: list[str]
    decays: tuple[float, ...]
    readout: LinearForecast
    spec: PanelSpec

    def setPredictionCol(self, name: str) -> "StatefulForecast":  # noqa: N802
        self.readout.setPredictionCol(name)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        states = [state_name(c, d) for c in self.inputs for d in self.decays]
        return self.readout.transform(with_states(rows, self.inputs, self.decays, self.spec)).drop(*states)


def fit_stateful(features: DataFrame, spec: PanelSpec, inputs: list[str] | None = None, decays: tuple[float, ...] = DECAYS,
                 reg_param: float = 0.0, elastic_net: float = 0.0) -> StatefulForecast:
    """Fit the read-out on the training split by weighted squares of the transformed target.

    States run over whole series, in training as in forecasting, so a step knows all of its past; steps count as
    often as training windows hold them. ``inputs`` are those that get states, by default all.
    """
    inputs = list(spec.feature_columns if inputs is None else inputs)
    columns = [*spec.feature_columns, *[state_name(c, d) for c in inputs for d in decays]]
    train = with_states(features.filter(F.col("split") == "train"), inputs, decays, spec)
    weighted = train.withColumns({ONE: F.lit(1.0), TARGET: F.col("y"), "fit_weight": F.col("w") * coverage(spec), "_all": F.lit(0)})
    sums = product_sums(weighted, [ONE, *columns, TARGET], "fit_weight", ["_all"])
    if not sums:
        raise ValueError(f"no training series reaches the look-back length {spec.lookback}")
    weights = penalised(np.asarray(sums[(0,)]), reg_param, elastic_net)
    return StatefulForecast(inputs, tuple(decays), LinearForecast(columns, weights), spec)
