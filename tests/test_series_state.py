"""States along series, and shuffled training batches."""

import math
from collections import Counter

import numpy as np
import pytest
import small
from pyspark.sql import functions as F

from panelcast.operators import forecast, recurrent, sequences, shuffling
from panelcast.plans import pipeline
from panelcast.sources import stage

SPEC = small.SPEC


@pytest.fixture(scope="module")
def panel(spark):
    return pipeline.prepare(spark.createDataFrame(small.facts()), SPEC)


def test_states_equal_the_recurrence(spark, panel):
    """Factors differ from step to step; one series has hundreds of chunks of three windows."""
    rows = stage.stage(panel.features().withColumn("f", 1 - (F.col("timesteps") % 7) / 10).withColumn(
        "x", F.when(F.col("timesteps") % 5 > 0, F.col("y"))), "features")
    assert rows.groupBy(*SPEC.pair).agg(F.countDistinct("chunk").alias("n")).agg(F.max("n")).first()[0] > 100
    got = recurrent.scanned(rows, {"h": (F.col("f"), F.col("x")), "s": (0.25, F.lit(1.0))}, SPEC)
    assert got.columns == [*rows.columns, "h", "s"]
    table = got.orderBy(*SPEC.pair, "position").toPandas()
    for _, part in table.groupby(SPEC.pair):
        h = s = 0.0
        for f, x, got_h, got_s in zip(part["f"], part["x"], part["h"], part["s"]):
            h, s = f * h + (0.0 if math.isnan(x) else x), 0.25 * s + 1.0
            assert got_h == pytest.approx(h, rel=1e-9, abs=1e-9) and got_s == pytest.approx(s, rel=1e-9)


def test_no_task_holds_a_series(spark, panel):
    rows = recurrent.with_states(panel.features(), ["years_since"], (0.5,), SPEC)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("chunk" in line for line in windows)
    assert "Python" not in plan and "Cartesian" not in plan


def test_stateful_forecast(spark, panel):
    features = stage.stage(panel.features(), "features")
    model = recurrent.fit_stateful(features, SPEC, ["post_intervention"], (0.6,))
    linear = forecast.fit("linear", features, SPEC)
    scored = forecast.predict({"linear": linear, "stateful": model}, features, SPEC)
    weight = F.when(F.col("split") == "train", sequences.coverage(SPEC) * F.col("w"))
    errors = scored.agg(*[F.sum(weight * (F.col(f"yhat_{m}") - F.col("y")) ** 2) for m in ("stateful", "linear")]).first()
    assert errors[0] <= errors[1] * (1 + 1e-9)  # states can only help on what was learned
    assert scored.count() == features.count() and not [c for c in scored.columns if "_h6" in c]
    with pytest.raises(ValueError):
        recurrent.fit_stateful(features, SPEC.with_(lookback=9_000))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 97, 1_000, 1_009, 4_096])
def test_places_are_a_permutation(spark, n):
    r = shuffling.radices(n)
    assert 0 <= r.excess and r.low * r.high == n + r.excess
    orders = []
    for epoch in (0, 1):
        rows = spark.range(n).select("id", shuffling.shuffled(F.col("id"), F.lit(epoch), r, 7).alias("p")).orderBy("id").collect()
        orders.append([x.p for x in rows])
        assert sorted(orders[-1]) == list(range(n))
    if n > 90:
        assert orders[0] != orders[1] and orders[0] != list(range(n))
        # neighbours do not stay together
        assert np.mean(np.abs(np.diff(orders[0]))) > n / 5


@pytest.mark.parametrize("n", [10**9 + 7, 2**40 + 1, 10**12 - 11])
def test_few_turns_at_any_size(n):
    assert shuffling.radices(n).excess < 50


def test_batches_of_an_epoch(spark, panel):
    for spec in (SPEC, SPEC.with_(train_stride=3, batch_size=7)):
        numbered = sequences.number_windows(panel.outline, spec)
        rows = shuffling.train_batches(numbered, spec, 2, first=5).collect()
        starts = sequences.window_starts(panel.outline, spec).filter("split = 'train'").collect()
        whole = len(starts) // spec.batch_size
        assert len(starts) % spec.batch_size  # there is a short batch to leave out
        for epoch in (5, 6):
            own = [r for r in rows if r.epoch == epoch]
            assert Counter(r.batch_id for r in own) == Counter({b: spec.batch_size for b in range(whole)})
            assert len({(r.batch_id, r.slot) for r in own}) == len(own)
            keys = {(r.parameter_index, r.simulation_index, r.start) for r in own}
            assert len(keys) == len(own) and keys <= {(r.parameter_index, r.simulation_index, r.start) for r in starts}
    plan = shuffling.train_batches(numbered, spec, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan.split("Join")[0]
