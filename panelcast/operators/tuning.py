"""Search over model parameters: Spark fits and scores each candidate, the driver only launches."""

from __future__ import annotations

import logging
import math
import random
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import forecast, losses, sequences
from panelcast.operators.boosting import BinnedSteps
from panelcast.operators.normal import ONE, TARGET, LinearForecast, penalised, product_sums
from panelcast.spec import PanelSpec

log = logging.getLogger(__name__)

# Look-back lengths to search and the weight decay range.
LOOKBACKS = (13, 26, 52, 78)
WEIGHT_DECAYS = (1e-6, 1e-1)
#: Attribute of a feature table under which trials find the binned steps that they share.
BINNED = "_binned_steps"
#: Boosting takes far larger steps than a gradient descent does.
STEP_SIZES = (1e-2, 3e-1)

TRIAL_SCHEMA = T.StructType([
    T.StructField("trial_number", T.LongType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("best_val_loss", T.DoubleType()),
    T.StructField("best_epoch", T.LongType()),
    T.StructField("state", T.StringType()),
])


@dataclass(frozen=True)
class Candidate:
    number: int
    family: str
    lookback: int
    params: dict[str, float]


def candidates(family: str, count: int, spec: PanelSpec, lookbacks: tuple[int, ...] = LOOKBACKS) -> list[Candidate]:
    """Seeded random candidates; the draws depend on seed and family only."""
    draw = random.Random(f"{spec.seed}:{family}")

    def log_uniform(low: float, high: float) -> float:
        return low * (high / low) ** draw.random()

    found = []
    for number in range(count):
        if family == "linear":
            params = {"regParam": log_uniform(*WEIGHT_DECAYS), "elasticNetParam": draw.random()}
        else:
            params = {
                "stepSize": log_uniform(*STEP_SIZES),
                "maxDepth": draw.randint(2, 5),
                "maxIter": draw.choice((5, 10, 20)),
                "subsamplingRate": 1.0 - 0.5 * draw.random(),
                "seed": spec.seed,
            }
        found.append(Candidate(number, family, draw.choice(lookbacks), params))
    return found


def validation_history(model, batched: DataFrame, candidate: Candidate, spec: PanelSpec) -> list[tuple[int, float]]:
    """Epoch and mean batch loss on the validation windows, one row per round; losses that are no numbers are inf."""
    rows = forecast.history(model, candidate.family, batched.filter(F.col("split") == "validate"), spec)
    found = [(r["epoch"], r["val_loss"]) for r in rows.select("epoch", "val_loss").collect()]
    if not found:
        raise ValueError(f"no validation series reaches the look-back length {spec.lookback}")
    return [(epoch, loss if loss is not None and math.isfinite(loss) else math.inf) for epoch, loss in found]


def run_trial(candidate: Candidate, features: DataFrame, spec: PanelSpec) -> tuple:
    """Fit on train, score on validate; a failing candidate, or one without a finite loss, scores infinity.

    The loss is the mean over validation batches after the best round, and that round is ``best_epoch``.
    ``features`` carries ``evaluation_windows_before`` for each look-back, see ``with_window_numbers``.
    """
    spec = spec.with_(lookback=candidate.lookback)
    shown = shown_parameters(candidate)
    loss, epoch, state = math.inf, None, "FAIL"
    try:
        model = forecast.fit(candidate.family, features, spec, getattr(features, BINNED, None), **candidate.params)
        batched = sequences.batched_steps(features, spec, numbered(candidate.lookback))
        epoch, loss = min(validation_history(model, batched, candidate, spec), key=lambda r: (r[1], r[0]))
        state = "COMPLETE" if math.isfinite(loss) else "FAIL"
    except (ValueError, RuntimeError, PySparkException, Py4JError) as error:
        log.error("trial %s of %s failed: %s", candidate.number, candidate.family, error)
    return (candidate.number, candidate.family, shown, loss, epoch if state == "COMPLETE" else None, state)


def shown_parameters(candidate: Candidate) -> dict[str, float]:
    return {**{k: float(v) for k, v in candidate.params.items()}, "lookback": float(candidate.lookback)}


def lookback_sums(features: DataFrame, lookbacks: list[int], spec: PanelSpec) -> dict[int, np.ndarray]:
    """Sums of products of the training steps for each look-back, from one pass over them."""
    each = [
        F.struct(F.lit(n).alias("lookback"), (F.col("w") * sequences.coverage(spec.with_(lookback=n))).alias("fit_weight"))
        for n in lookbacks
    ]
    columns = [ONE, *spec.feature_columns, TARGET]
    train = features.filter(F.col("split") == "train").withColumns({ONE: F.lit(1.0), TARGET: F.col("y")})
    found = product_sums(train.select(*columns, F.inline(F.array(*each))), columns, "fit_weight", ["lookback"])
    return {lookback: sums for (lookback,), sums in found.items()}


def linear_trials(drawn: list[Candidate], features: DataFrame, spec: PanelSpec, deadline: float | None = None) -> list[tuple]:
    """All linear candidates: one pass over the training steps, and one per look-back over the validation windows.

    The penalised systems are solved from the same sums; the forecasts of all candidates of a look-back are scored side by
    side. Results are as those of ``run_trial``.
    """
    results, lookbacks = [], list(dict.fromkeys(c.lookback for c in drawn))
    late = deadline is not None and time.monotonic() > deadline
    sums = {} if late else lookback_sums(features, lookbacks, spec)
    for lookback in lookbacks:
        own, losses_, state = [c for c in drawn if c.lookback == lookback], {}, "FAIL"
        if deadline is not None and time.monotonic() > deadline:
            state = "SKIPPED"
        elif lookback not in sums:
            log.error("%s linear trials failed: no training series reaches the look-back length %s", len(own), lookback)
        else:
            spec_ = spec.with_(lookback=lookback)
            scored = sequences.batched_steps(features.filter(F.col("split") == "validate"), spec_, numbered(lookback))
            for c in own:
                weights = penalised(sums[lookback], c.params.get("regParam", 0.0), c.params.get("elasticNetParam", 0.0))
                scored = LinearForecast(spec.feature_columns, weights).setPredictionCol(
                    losses.forecast_of(str(c.number))).transform(scored)
            found = losses.mean_batch_loss(scored, [str(c.number) for c in own], ["model"], spec_)
            losses_ = {int(r["model"]): r["mean_batch_loss"] for r in found.select("model", "mean_batch_loss").collect()}
        for c in own:
            loss = losses_.get(c.number)
            good = loss is not None and math.isfinite(loss)
            results.append((c.number, c.family, shown_parameters(c), loss if good else math.inf,
                            1 if good else None, "COMPLETE" if good else state))
    return sorted(results)


def numbered(lookback: int) -> str:
    """Name of the column with the number of earlier evaluation windows at this look-back."""
    return f"windows_before_{lookback}"


def one_by_one(drawn: list[Candidate], features: DataFrame, spec: PanelSpec, parallel_trials: int = 1,
               deadline: float | None = None) -> list[tuple]:
    """Each candidate by ``run_trial``, in threads whose jobs carry a tag by which they are cancelled at the deadline."""
    spark, tag = features.sparkSession, f"trials-{uuid.uuid4().hex}"
    context, over = spark.sparkContext, threading.Event()
    features, binned = features.select("*"), BinnedSteps()
    setattr(features, BINNED, binned)  # for the trials of this call, which read the same steps

    def attempt(candidate: Candidate) -> tuple:
        late = (candidate.number, candidate.family, shown_parameters(candidate), math.inf, None)
        if deadline is not None and time.monotonic() > deadline:
            return (*late, "SKIPPED")
        context.addJobTag(tag)
        try:
            found = run_trial(candidate, features, spec)
        finally:
            context.removeJobTag(tag)
        ended = deadline is not None and time.monotonic() > deadline
        return (*late, "CANCELLED") if found[-1] == "FAIL" and ended else found

    def watch() -> None:
        while not over.wait(max(0.0, deadline - time.monotonic()) if time.monotonic() < deadline else 0.5):
            context.cancelJobsWithTag(tag)  # again and again, as a trial has many jobs

    watcher = None if deadline is None else threading.Thread(target=inheritable_thread_target(spark)(watch), daemon=True)
    if watcher is not None:
        watcher.start()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel_trials)) as pool:
            # each trial runs in a copy of the caller's context, and its thread has the caller's local properties
            tasks = [pool.submit(copy_context().run, inheritable_thread_target(spark)(attempt), c) for c in drawn]
            return [task.result() for task in tasks]
    finally:
        over.set()
        binned.unstage()


def search(features: DataFrame, spec: PanelSpec, families: tuple[str, ...] = tuple(forecast.FAMILIES),
           trials: int = 32, parallel_trials: int = 1, timeout: float | None = None,
           lookbacks: tuple[int, ...] = LOOKBACKS,
           chosen: dict[str, list[Candidate]] | None = None) -> DataFrame:
    """Trial table over all families; ``features`` is a staged table, since every trial reads it.

    Linear candidates share their passes (``linear_trials``); boosted ones are fitted one by one. Each family gets an equal part of the timeout; once it is used up no further trial starts, and those
    left are recorded as ``SKIPPED``. Set ``spark.scheduler.mode=FAIR`` to let parallel trials share executors
    evenly. ``chosen`` replaces the random candidates of a family.
    """
    results = []
    for family in families:
        deadline = None if timeout is None else time.monotonic() + timeout / len(families)

        drawn = (chosen or {}).get(family) or candidates(family, trials, spec, lookbacks)
        if family == "linear":
            results += linear_trials(drawn, features, spec, deadline)
        else:
            results += one_by_one(drawn, features, spec, parallel_trials, deadline)
    return features.sparkSession.createDataFrame(results, TRIAL_SCHEMA)
