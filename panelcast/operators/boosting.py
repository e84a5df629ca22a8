"""Boosted trees grown round by round on what is left of the target, stopped by patience on the validation windows.

A tree tells values of an input apart only by its bin, so steps of equal bins are summed first: a fit then reads one row per
cell of bins, with the weight and the weighted target of its steps, and finds the trees that the steps themselves would
give. Bounds of bins are those of Spark ML's trees: from all steps, or from about ``SAMPLE`` of them where there are more. A round that takes
a share of the steps draws each step by a hash of its key, so draws do not hang on partitions; the sums of all rounds come from one
pass over steps that are staged in the order of their cells.

For early stopping the whole loss is taken over the validation batches after each round, for ``RESTAGE`` rounds in one pass.
Training ends once ``patience`` rounds brought no gain, and the model keeps the trees up to its best round. Running totals
are a column of the staged rows, which are staged anew every few rounds so that plans stay short.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import losses
from panelcast.sources.stage import stage, unstage
from panelcast.spec import PanelSpec

RESTAGE = 8
FORECAST = "boosted"
#: Spark ML's defaults: bins of an input, and steps from which their bounds are taken.
MAX_BINS = 32
SAMPLE = 10_000
_VECTOR = "_bins"


def bounds_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` bounds between neighbouring values, which part the weight evenly if not all of them can be had."""
    known = ~np.isnan(values)
    distinct, back = np.unique(values[known], return_inverse=True)
    middles = (distinct[1:] + distinct[:-1]) / 2
    if len(middles) > most:
        reached = np.cumsum(np.bincount(back, weights[known]))
        stride = reached[-1] / (most + 1)
        chosen, target = [], stride
        for k in range(len(middles)):
            if abs(reached[k] - target) < abs(reached[k + 1] - target):
                chosen.append(k)
                target += stride
        middles = middles[chosen]
    return np.unique(middles)


@dataclass(frozen=True)
class Bins:
    """Bounds of each input. The bin of a value is the number of bounds below it."""

    columns: list[str]
    bounds: list[np.ndarray]

    @property
    def names(self) -> list[str]:
        return [f"_bin_{k}" for k in range(len(self.columns))]

    @classmethod
    def of(cls, train: DataFrame, columns: list[str], seed: int) -> "Bins":
        """From the training steps and their ``fit_weight``; a ValueError without any."""
        n = train.count()
        if not n:
            raise ValueError("no training steps")
        some = train if n <= SAMPLE else train.sample(False, SAMPLE / n, seed)
        rows = np.array(some.select(*[F.col(c).cast("double") for c in columns], "fit_weight").collect(), float)
        rows = rows.reshape(-1, len(columns) + 1)
        most = min(MAX_BINS, n) - 1
        return cls(list(columns), [bounds_of(rows[:, k], rows[:, -1], most) for k in range(len(columns))])

    def add(self, rows: DataFrame) -> DataFrame:
        """Add the bin of each input; a missing value has none."""
        varied = [k for k, bounds in enumerate(self.bounds) if len(bounds)]
        if varied:
            rows = Bucketizer(
                splitsArray=[[-math.inf, *np.nextafter(self.bounds[k], math.inf).tolist(), math.inf] for k in varied],
                inputCols=[self.columns[k] for k in varied], outputCols=[self.names[k] for k in varied]).transform(rows)
        return rows.withColumns({
            name: F.col(name).cast("tinyint") if len(bounds) else F.when(F.col(c).isNotNull(), 0).cast("tinyint")
            for name, c, bounds in zip(self.names, self.columns, self.bounds)})

    def vector(self, rows: DataFrame) -> DataFrame:
        """Add the bins as the vector that trees read."""
        return VectorAssembler(inputCols=self.names, outputCol=_VECTOR).transform(rows)


class Boosted:
    """Trees over bins and their weights, used like a fitted model."""

    def __init__(self, bins: Bins, trees: list, weights: list[float]) -> None:
        self.bins, self.trees, self.treeWeights = bins, trees, weights  # noqa: N815  as fitted models have it
        self.name = "prediction"

    def setPredictionCol(self, name: str) -> "Boosted":  # noqa: N802
        self.name = name
        return self

    def after_rounds(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Add the forecast after each round under the round's name, each tree scored once."""
        rows = self.bins.vector(self.bins.add(rows))
        return _after(rows, list(zip(self.trees, self.treeWeights)), F.lit(0.0), names).drop(_VECTOR, *self.bins.names)

    def transform(self, rows: DataFrame) -> DataFrame:
        names = [f"_round_{k}" for k in range(len(self.trees))]
        last = F.col(names[-1]) if names else F.lit(0.0)
        return self.after_rounds(rows, names).withColumn(self.name, last).drop(*names)


def _after(rows: DataFrame, trees: list, total, names: list[str]) -> DataFrame:
    for k, (tree, _) in enumerate(trees):
        rows = tree.setPredictionCol(f"_tree_{k}").transform(rows)
    for k, (name, (_, weight)) in enumerate(zip(names, trees)):
        total = total + F.lit(float(weight)) * F.col(f"_tree_{k}")
        rows = rows.withColumn(name, total)
    return rows.drop(*[f"_tree_{k}" for k in range(len(trees))])


@dataclass
class Training:
    """A model cut back to its best round, and the loss of every round that ran."""

    model: Boosted
    losses: list[float]
    best_epoch: int | None
    stopped_early: bool

    @property
    def stop_epoch(self) -> int:
        return len(self.losses)


class BinnedSteps:
    """Training steps by look-back, binned and staged in the order of their cells, for all trials that share them."""

    def __init__(self) -> None:
        self._lock, self._locks, self._made = threading.Lock(), {}, {}

    def get(self, lookback: int, make) -> tuple[Bins, DataFrame]:
        with self._lock:
            own = self._locks.setdefault(lookback, threading.Lock())
        with own:
            if lookback not in self._made:
                self._made[lookback] = make()
            return self._made[lookback]

    def unstage(self) -> None:
        for _, steps in self._made.values():
            unstage(steps)


def binned_steps(train: DataFrame, spec: PanelSpec, seed: int) -> tuple[Bins, DataFrame]:
    """Bins, ``y``, ``fit_weight`` and ``_draw``, a hash of the step's key, staged in the order of their cells.

    Ranges end inside a common cell where they must, so no task gets more than its part.
    """
    bins = Bins.of(train, spec.feature_columns, seed)
    rows = bins.add(train).select(*bins.names, "y", "fit_weight", F.xxhash64(*spec.pair, "position").alias("_draw"))
    return bins, stage(rows.repartitionByRange(*bins.names, "_draw"), "binned_steps")


def cell_sums(steps: DataFrame, bins: Bins, rounds: int, rate: float, seed: int) -> DataFrame:
    """A row per cell with the weight ``_w_<k>`` and the weighted target ``_s_<k>`` of the steps that round ``k`` draws.

    Without draws all rounds share ``_w_1`` and ``_s_1``.
    """
    weight, target, sums = F.col("fit_weight"), F.col("fit_weight") * F.col("y"), []
    for k in range(1, rounds + 1 if rate < 1.0 else 2):
        if rate < 1.0:
            drawn = F.xxhash64("_draw", F.lit(int(seed) + k)) < F.lit(int((2.0 * rate - 1.0) * 2.0**63))
            each = F.when(drawn, weight), F.when(drawn, target)
        else:
            each = weight, target
        sums += [F.sum(c).alias(f"{name}_{k}") for name, c in zip(("_w", "_s"), each)]
    return steps.groupBy(*bins.names).agg(*sums)


def grow(cells: DataFrame, bins: Bins, maxIter: int, stepSize: float, maxDepth: int, rate: float, seed: int) -> Iterator[tuple]:  # noqa: N803
    """Tree and weight of each round, from the sums of cells.

    The first tree fits the target, each later one the slope of the squared error, taken by ``stepSize``.
    """
    rows, staged = bins.vector(cells.withColumn("_total", F.lit(0.0))).drop(*bins.names), None
    try:
        for k in range(1, int(maxIter) + 1):
            own, weight = k if rate < 1.0 else 1, 1.0 if k == 1 else float(stepSize)
            mean = F.col(f"_s_{own}") / F.col(f"_w_{own}")
            left = mean if k == 1 else 2.0 * (mean - F.col("_total"))
            part = rows.filter(F.col(f"_w_{own}") > 0).select(_VECTOR, left.alias("_left"), F.col(f"_w_{own}").alias("_weight"))
            tree = DecisionTreeRegressor(featuresCol=_VECTOR, labelCol="_left", weightCol="_weight", predictionCol="_tree",
                                         maxDepth=int(maxDepth), maxBins=MAX_BINS, seed=int(seed) + k).fit(part)
            yield tree, weight
            if k == maxIter:
                break
            rows = _after(rows, [(tree, weight)], F.col("_total"), ["_total"])
            if k % RESTAGE == 0:
                before, staged = staged, stage(rows, "boosting")
                rows = staged
                if before is not None:
                    unstage(before)
    finally:
        if staged is not None:
            unstage(staged)


def fit_boosted(train: DataFrame, spec: PanelSpec, shared: BinnedSteps | None = None, maxIter: int = 20, stepSize: float = 0.1,  # noqa: N803
                maxDepth: int = 5, subsamplingRate: float = 1.0, seed: int = 42) -> Boosted:  # noqa: N803
    """All rounds. ``train`` holds the key, ``position``, the inputs, ``y`` and ``fit_weight``; trials may share what is binned."""
    rate, own = float(subsamplingRate), None
    if shared is not None:
        bins, steps = shared.get(spec.lookback, lambda: binned_steps(train, spec, seed))
    elif rate < 1.0:
        bins, steps = binned_steps(train, spec, seed)
        own = steps
    else:
        bins = Bins.of(train, spec.feature_columns, seed)
        steps = bins.add(train)
    cells = stage(cell_sums(steps, bins, int(maxIter), rate, seed), "cells")
    try:
        grown = list(grow(cells, bins, maxIter, stepSize, maxDepth, rate, seed))
    finally:
        unstage(cells)
        if own is not None:
            unstage(own)
    return Boosted(bins, [tree for tree, _ in grown], [weight for _, weight in grown])


def fit_rounds(train: DataFrame, validate: DataFrame, spec: PanelSpec, patience: int | None = None, maxIter: int = 20,  # noqa: N803
               stepSize: float = 0.1, maxDepth: int = 5, subsamplingRate: float = 1.0, seed: int = 42) -> Training:  # noqa: N803
    """Grow at most ``maxIter`` trees; without ``patience`` all of them.

    ``train`` is as in ``fit_boosted``; ``validate`` holds the batched steps of validation windows with the inputs. A loss
    that is no number is no gain. Without any gain no tree is kept and the forecast is zero.
    """
    rate = float(subsamplingRate)
    if train.isEmpty() or validate.isEmpty():
        raise ValueError(f"no training or no validation series reaches the look-back length {spec.lookback}")
    if rate < 1.0:
        bins, steps = binned_steps(train, spec, seed)
    else:
        bins = Bins.of(train, spec.feature_columns, seed)
        steps = bins.add(train)
    cells = stage(cell_sums(steps, bins, int(maxIter), rate, seed), "cells")
    if rate < 1.0:
        unstage(steps)
    judged = stage(bins.add(validate).drop(*bins.columns).withColumn("_total", F.lit(0.0)), "boosting_windows")
    growing = grow(cells, bins, maxIter, stepSize, maxDepth, rate, seed)
    trees, seen, best, epoch, stopped = [], [], math.inf, 0, False
    try:
        while not stopped:
            block = list(islice(growing, RESTAGE))
            if not block:
                break
            names = [str(len(trees) + k) for k in range(1, len(block) + 1)]
            trees += block
            forecasts = [losses.forecast_of(name) for name in names]
            scored = _after(bins.vector(judged), block, F.col("_total"), forecasts).drop(_VECTOR, "_total")
            found = {r["model"]: r["mean_batch_loss"] for r in losses.mean_batch_loss(scored, names, ["model"], spec).collect()}
            for name in names:
                k, loss = int(name), found.get(name)
                seen.append(math.nan if loss is None else loss)
                if seen[-1] < best:
                    best, epoch = seen[-1], k
                elif patience is not None and k - epoch >= patience:
                    stopped = True
                    break
            if not stopped and len(trees) < maxIter:
                last = scored.withColumn("_total", F.col(forecasts[-1])).drop(*forecasts)
                before, judged = judged, stage(last, "boosting_windows")
                unstage(before)
    finally:
        growing.close()
        unstage(judged)
        unstage(cells)
    model = Boosted(bins, [tree for tree, _ in trees[:epoch]], [weight for _, weight in trees[:epoch]])
    return Training(model, seen, epoch or None, stopped)
