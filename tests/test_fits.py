"""Fits on the shape loss, penalised fits from sums, and boosting that stops early."""

import numpy as np
import pytest
import small
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelcast.operators import boosting, forecast, normal, runs, sequences, shape_fit, tuning
from panelcast.plans import pipeline
from panelcast.sources import stage

SPEC = small.SPEC.with_(slope_weight=0.6, curvature_weight=0.3)


@pytest.fixture(scope="module")
def features(spark):
    panel = pipeline.prepare(spark.createDataFrame(small.facts()), SPEC)
    return stage.stage(pipeline.features_with_windows(panel, (4, 5)), "features")


def train_windows(features, spec, natural=False):
    """Every training window as arrays of inputs with the constant, target and weight."""
    found = []
    columns = spec.feature_columns
    rows = features.filter("split = 'train'").orderBy(*spec.pair, "position").toPandas()
    for _, part in rows.groupby(spec.pair):
        x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
        y, w = part["y"].to_numpy(), part["w"].to_numpy()
        found += [(x[s:s + spec.lookback], y[s:s + spec.lookback], w[s:s + spec.lookback])
                  for s in range(len(part) - spec.lookback + 1)]
    return found


def whole_loss(windows, weights, spec, inverse=lambda v: v):
    """Level, slope and curvature over all windows as one batch."""
    errors = [inverse(x @ weights) - inverse(y) for x, y, _ in windows]
    mids = [w for _, _, w in windows]
    total = 0.0
    for share in (1.0, spec.slope_weight, spec.curvature_weight):
        top = sum(float(w @ (e * e)) for e, w in zip(errors, mids))
        total += share * top / max(sum(w.sum() for w in mids), 1.0)
        errors, mids = [np.diff(e) for e in errors], [(w[1:] + w[:-1]) / 2 for w in mids]
    return total


@pytest.mark.parametrize("mode", ["prevalence", "cases"])
def test_shape_fit_is_the_minimum_over_all_windows(spark, mode):
    spec = SPEC.with_(mode=mode, loss_space="transformed")
    rows = stage.stage(pipeline.prepare(spark.createDataFrame(small.facts()), spec).features(), "features")
    windows = train_windows(rows, spec)
    model = shape_fit.fit_shape(rows, spec)
    # the same squares stacked as one plain least-squares system
    blocks, targets = [], []
    for order, share in enumerate((1.0, spec.slope_weight, spec.curvature_weight)):
        parts = [(np.diff(x, order, axis=0), np.diff(y, order), w) for x, y, w in windows]
        for _ in range(order):
            parts = [(x, y, (w[1:] + w[:-1]) / 2) for x, y, w in parts]
        scale = share / max(sum(w.sum() for _, _, w in parts), 1.0)
        blocks += [np.sqrt(scale * w)[:, None] * x for x, _, w in parts]
        targets += [np.sqrt(scale * w) * y for _, y, w in parts]
    want = np.linalg.lstsq(np.vstack(blocks), np.concatenate(targets), rcond=None)[0]
    best = whole_loss(windows, want, spec)
    assert whole_loss(windows, model.weights, spec) == pytest.approx(best, rel=1e-7)


def test_without_shape_it_is_the_plain_fit(features):
    spec = SPEC.with_(loss_space="transformed", slope_weight=0.0, curvature_weight=0.0)
    shape = forecast.predict({"shape": shape_fit.fit_shape(features, spec)}, features, spec)
    both = forecast.predict({"linear": forecast.fit("linear", features, spec)}, shape, spec)
    assert both.agg(F.max(F.abs(F.col("yhat_shape") - F.col("yhat_linear")))).first()[0] < 1e-5


def test_natural_space_ends_where_no_step_helps(features):
    spec = SPEC.with_(loss_space="natural")
    windows = train_windows(features, spec)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    start = shape_fit.fit_shape(features, spec.with_(loss_space="transformed"))
    model = shape_fit.fit_shape(features, spec, rounds=14, tolerance=1e-12)
    train = features.filter("split = 'train'")
    losses = [whole_loss(windows, m.weights, spec, sigmoid) for m in (start, model)]
    assert shape_fit.natural_losses(train, [start, model], spec) == pytest.approx(losses, rel=1e-9)
    assert losses[1] < losses[0]
    rng = np.random.default_rng(0)
    for _ in range(200):
        near = model.weights + rng.normal(scale=1e-3, size=len(model.weights))
        assert whole_loss(windows, near, spec, sigmoid) > losses[1] * (1 - 1e-6)


def test_rounds_in_natural_space_shuffle_no_steps(features):
    """Steps meet their runs once, when they are staged; every later pass finds them in its bucket."""
    spec = SPEC.with_(loss_space="natural")
    train = features.filter("split = 'train'")
    model = normal.LinearForecast(spec.feature_columns, np.linspace(-0.2, 0.2, len(spec.feature_columns) + 1))
    runs = shape_fit.staged_runs(train, spec)
    steps = shape_fit.differenced_steps(shape_fit.linearised(runs, model, spec), [normal.ONE, normal.TARGET], [0, 1, 2], spec)
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert shape_fit.natural_losses(runs, [model], spec) == pytest.approx(shape_fit.natural_losses(train, [model], spec), rel=1e-12)
    assert shape_fit.loss_sums(runs, model, spec) == pytest.approx(shape_fit.loss_sums(train, model, spec), rel=1e-9)


def test_no_training_window_is_an_error(features):
    with pytest.raises(ValueError):
        shape_fit.fit_shape(features, SPEC.with_(lookback=5_000))


def test_series_longer_than_a_run_is_differenced_across(features):
    """The dominant series has hundreds of steps in runs of four."""
    spec = SPEC.with_(loss_space="transformed")
    assert features.agg(F.max("valid_length")).first()[0] > 50 * spec.chunk
    steps = shape_fit.differenced_steps(features.filter("split = 'train'").withColumn("_t", F.col("y")), ["_t"], [0, 1, 2], spec)
    got = {r["order"]: (r["n"], r["s"]) for r in steps.groupBy("order").agg(
        F.sum("fit_weight").alias("n"), F.sum(F.col("fit_weight") * F.col("_t") ** 2).alias("s")).collect()}
    for order in (0, 1, 2):
        parts = [(np.diff(y, order), w[order:]) for _, y, w in train_windows(features, spec)]  # all weights are 1
        assert got[order] == pytest.approx((sum(w.sum() for _, w in parts), sum(float(w @ (d * d)) for d, w in parts)))


@pytest.mark.parametrize("reg_param, elastic_net", [(0.0, 0.0), (0.05, 0.0), (0.02, 1.0), (0.3, 0.4), (9.0, 1.0)])
def test_penalised_sums_equal_spark_ml(spark, reg_param, elastic_net):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(80, 3)) * [1, 5, 0.1] + [0, 2, 7], np.full(80, 3.0)])
    y, w = x @ [0.5, -0.2, 4.0, 1.0] + rng.normal(size=80), rng.uniform(0.1, 2, 80)
    rows = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "y", "w"])
    model = LinearRegression(labelCol="y", weightCol="w", regParam=reg_param, elasticNetParam=elastic_net, tol=1e-12, maxIter=1000).fit(rows)
    stacked = np.column_stack([np.ones(80), x, y])
    got = normal.penalised(stacked.T @ (w[:, None] * stacked), reg_param, elastic_net)
    assert got[1:] == pytest.approx(model.coefficients.toArray(), abs=2e-5)
    assert got[0] == pytest.approx(model.intercept, abs=2e-4)


def test_trials_from_sums_equal_trials_one_by_one(features):
    drawn = [tuning.Candidate(k, "linear", n, p) for k, (n, p) in enumerate(
        [(4, {}), (5, {"regParam": 0.1}), (4, {"regParam": 0.01, "elasticNetParam": 0.5}), (5_000, {})])]
    numbered = features.withColumn(tuning.numbered(5_000), F.lit(0))
    together = tuning.linear_trials(drawn, numbered, SPEC)
    for got, candidate in zip(together, drawn):
        want = tuning.run_trial(candidate, numbered, SPEC)
        assert got[:3] == want[:3] and got[4:] == want[4:]
        assert got[3] == pytest.approx(want[3], rel=1e-4)


def test_boosting_stops_and_keeps_its_best_round(spark, features):
    before = tuning.numbered(SPEC.lookback)
    whole = forecast.fit_early(features, SPEC, before, patience=100, maxIter=12, stepSize=0.8, maxDepth=4, seed=3)
    assert whole.stop_epoch == 12 and not whole.stopped_early
    history = forecast.early_history(whole, spark)
    short = forecast.fit_early(features, SPEC, before, patience=2, maxIter=12, stepSize=0.8, maxDepth=4, seed=3)
    report = runs.run_report(history, ["model"], 2).first()
    assert report.stopped_early and 12 > short.stop_epoch  # the case is worth testing
    assert (short.stop_epoch, short.best_epoch, short.stopped_early) == (report.stop_epoch, report.best_epoch, report.stopped_early)
    assert short.losses == pytest.approx(whole.losses[:short.stop_epoch], rel=1e-9)
    assert len(short.model.trees) == short.best_epoch
    # the model that is kept scores the best round's loss
    batched = sequences.batched_steps(features, SPEC, before)
    last = forecast.history(short.model, "boosted", batched, SPEC).orderBy(F.desc("epoch")).first()
    assert (last.epoch, last.val_loss) == (short.best_epoch, pytest.approx(report.best_val_loss, rel=1e-9))
    assert last.train_loss is not None and boosting.RESTAGE < 12


def test_cells_give_the_trees_of_spark_ml(features):
    """Sums of steps of equal bins lead to the forecasts of trees that are fitted on the steps themselves."""
    model = forecast.fit("boosted", features, SPEC, maxIter=6, stepSize=0.4, maxDepth=4, seed=2)
    want = forecast.create_model("boosted", maxIter=6, stepSize=0.4, maxDepth=4, seed=2).setPredictionCol("want").fit(
        forecast.training_rows(features, SPEC))
    both = model.setPredictionCol("got").transform(want.transform(forecast.assemble(features, SPEC)))
    assert both.agg(F.max(F.abs(F.col("got") - F.col("want")))).first()[0] < 1e-9
    steps = forecast.boosting_steps(features, SPEC)
    assert boosting.cell_sums(model.bins.add(steps), model.bins, 6, 1.0, 2).count() < steps.count()


def test_losses_of_several_rounds_come_from_one_pass(features, monkeypatch):
    passes, whole = [], boosting.losses.mean_batch_loss
    monkeypatch.setattr(boosting.losses, "mean_batch_loss", lambda rows, models, *a: passes.append(models) or whole(rows, models, *a))
    found = forecast.fit_early(features, SPEC, tuning.numbered(SPEC.lookback), patience=100, maxIter=10, maxDepth=2, seed=3)
    assert found.stop_epoch == 10 and [len(p) for p in passes] == [boosting.RESTAGE, 10 - boosting.RESTAGE]


def test_drawn_steps_do_not_hang_on_partitions(features):
    drawn = {"maxIter": 3, "maxDepth": 3, "seed": 5, "subsamplingRate": 0.6}
    one, two = (forecast.fit("boosted", f, SPEC, **drawn) for f in (features, features.repartition(7, "position")))
    both = two.setPredictionCol("two").transform(one.setPredictionCol("one").transform(features))
    assert both.agg(F.max(F.abs(F.col("one") - F.col("two")))).first()[0] < 1e-9
    steps = boosting.Bins.add(one.bins, forecast.boosting_steps(features, SPEC)).withColumn("_draw", F.xxhash64(*SPEC.pair, "position"))
    sums = boosting.cell_sums(steps, one.bins, 2, 0.6, 5).agg(F.sum("_w_1"), F.sum("_w_2")).first()
    share = [x / steps.agg(F.sum("fit_weight")).first()[0] for x in sums]
    assert all(0.5 < x < 0.7 for x in share) and share[0] != share[1]


def test_winner_of_the_search_is_refitted_as_it_was_ranked(features):
    candidate = tuning.Candidate(0, "boosted", 4, {"maxIter": 8, "stepSize": 0.9, "maxDepth": 4, "seed": 5})
    _, _, shown, loss, epoch, _ = tuning.run_trial(candidate, features, SPEC)
    assert epoch < 8
    chosen = pipeline.winning_parameters(shown, epoch)
    model = pipeline.fit_models(features, SPEC, {"boosted": chosen})["boosted"]
    batched = sequences.batched_steps(features, SPEC, tuning.numbered(4))
    assert forecast.history(model, "boosted", batched, SPEC).orderBy(F.desc("epoch")).first().val_loss == pytest.approx(loss, rel=1e-9)
