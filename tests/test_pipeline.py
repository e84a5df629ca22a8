"""The whole path against the one-series-at-a-time version, over a table full of awkward series."""

import brute
import numpy as np
import pandas as pd
import pytest
import small
from pyspark.sql import functions as F

from panelcast.operators import baselines, losses, metrics, outline, sequences, windows
from panelcast.plans import pipeline
from panelcast.sources.facts import read_facts
from panelcast.spec import PanelSpec

PAIR = brute.PAIR
SPECS = {
    "prevalence": small.SPEC,
    "prevalence-cyclic": small.SPEC.with_(cyclic_time=True, loss_space="transformed"),
    "cases": small.SPEC.with_(mode="cases", min_cases=20.0, train_stride=3),
    "one-chunk": small.SPEC.with_(chunk=100_000),
}


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(small.facts()).repartition(3)


@pytest.fixture(scope="module", params=SPECS)
def case(request, facts):
    spec = SPECS[request.param]
    panel = pipeline.prepare(facts, spec)
    rows = brute.keep(brute.windows(small.facts(), spec), spec)
    label = brute.labels(rows.parameter_index, spec)
    return spec, panel, rows, label


def same(got: pd.DataFrame, want: pd.DataFrame, keys: list[str]):
    got = got.sort_values(keys, ignore_index=True)
    want = want.sort_values(keys, ignore_index=True)[list(got.columns)]
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object or str(got[c].dtype).startswith("str"):
            assert list(got[c]) == list(want[c]), c
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_steps(case):
    spec, panel, rows, _ = case
    steps = windows.with_steps(panel.windows, panel.outline, spec)
    got = steps.select(*PAIR, "global_index", "group_id", "abs_timesteps", "timesteps",
                       F.col(spec.target).alias("target")).toPandas()
    same(got, rows, [*PAIR, "timesteps"])


def test_split_labels_follow_parameters(case):
    spec, panel, _, label = case
    got = outline.one_per_series(panel.outline).select(*PAIR, "split").collect()
    assert {r[0]: r[2] for r in got} == label
    assert len(got) == len({(r[0], r[1]) for r in got})


def test_features(case):
    spec, panel, rows, label = case
    want = brute.features(rows, label, spec)
    columns = [*PAIR, "split", "timesteps", "abs_timesteps", "position", "valid_length", *spec.feature_columns, "y", "w"]
    same(panel.features().select(*columns).toPandas(), want, [*PAIR, "timesteps"])


def test_window_starts_and_arrays(case):
    spec, panel, rows, label = case
    want = brute.features(rows, label, spec)
    expected = {}
    for (param, sim), g in want.groupby(PAIR):
        for s in brute.starts(len(g), g.split.iloc[0], spec):
            w = g.iloc[s:s + spec.lookback]
            expected[param, sim, s] = (w[spec.feature_columns].to_numpy(float), w.y.to_numpy(), w.w.to_numpy())
    starts = {(r[0], r[1], r[3]) for r in sequences.window_starts(panel.outline, spec).collect()}
    assert starts == set(expected)
    arrays = sequences.window_arrays(panel.features(), spec).collect()
    assert len(arrays) == len(expected)
    for r in arrays:
        x, y, w = expected[r.parameter_index, r.simulation_index, r.start]
        np.testing.assert_allclose(np.array(r.x), x, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(r.y, y)
        np.testing.assert_allclose(r.w, w)


def test_coverage_counts_training_windows(case):
    spec, panel, rows, label = case
    want = brute.features(rows, label, spec)
    expected = {}
    for (param, sim), g in want[want.split == "train"].groupby(PAIR):
        count = np.zeros(len(g))
        for s in brute.starts(len(g), "train", spec):
            count[s:s + spec.lookback] += 1
        expected |= {(param, sim, p): c for p, c in enumerate(count)}
    got = panel.features().filter("split = 'train'").select(*PAIR, "position", sequences.coverage(spec).alias("n"))
    assert {tuple(r)[:3]: r.n for r in got.collect()} == expected


def scored_windows(case):
    """Truth, persistence forecast and weight of each evaluation window, in order, per split."""
    spec, _, rows, label = case
    want = brute.features(rows, label, spec)
    season = (want.abs_timesteps % 365) // baselines.SEASON_DAYS
    train = want[want.split == "train"]
    means = train.y.groupby(season[train.index]).mean()
    want["seasonal"] = season.map(means).fillna(train.y.mean())
    want["persistence"] = want.groupby(PAIR).y.shift(1).fillna(want.seasonal)
    out = {}
    for (_, _), g in want.sort_values([*PAIR, "position"]).groupby(PAIR, sort=True):
        for s in range(0, len(g) - spec.lookback + 1, spec.lookback):
            out.setdefault(g.split.iloc[0], []).append(g.iloc[s:s + spec.lookback])
    return out


def test_losses_and_metrics(case):
    spec, panel, _, _ = case
    rows = pipeline.evaluation_rows(panel)
    by = ["model", "split"]
    total = {tuple(r)[:2]: r.total_loss for r in losses.shape_loss(rows, baselines.BASELINES, by, spec).collect()}
    batch = {tuple(r)[:2]: r for r in losses.mean_batch_loss(rows, baselines.BASELINES, by, spec).collect()}
    record = {tuple(r)[:2]: r for r in metrics.metrics_record(rows, baselines.BASELINES, by, spec).collect()}
    wanted = scored_windows(case)
    assert set(total) == {(m, s) for m in baselines.BASELINES for s in wanted}
    for split, found in wanted.items():
        t, w = np.stack([g.y for g in found]), np.stack([g.w for g in found])
        for model in baselines.BASELINES:
            p = np.stack([g[model] for g in found])
            assert total[model, split] == pytest.approx(brute.loss(p, t, w, spec), rel=1e-9)
            cuts = range(0, len(found), spec.batch_size)
            size = spec.batch_size
            each = [brute.loss(p[i:i + size], t[i:i + size], w[i:i + size], spec) for i in cuts]
            level = [brute.mean_square(zip(w[i:i + size].ravel(), (p - t)[i:i + size].ravel())) for i in cuts]
            assert batch[model, split].mean_batch_loss == pytest.approx(np.mean(each), rel=1e-9)
            assert batch[model, split].n_batches == len(each)
            r = record[model, split]
            assert r.avg_loss_transformed == pytest.approx(np.mean(level), rel=1e-9)
            pn, tn = (np.array([brute.natural(v, spec) for v in x.ravel()]) for x in (p, t))
            e = pn - tn
            assert r.n == len(e)
            assert r.mse == pytest.approx((e ** 2).mean(), rel=1e-9)
            assert r.rmse == pytest.approx(np.sqrt((e ** 2).mean()), rel=1e-9)
            assert r.mae == pytest.approx(np.abs(e).mean(), rel=1e-9)
            assert r.bias == pytest.approx(e.mean(), rel=1e-6, abs=1e-12)
            assert r.r2 == pytest.approx(1 - (e ** 2).sum() / ((tn - tn.mean()) ** 2).sum(), rel=1e-9)
            assert r.smape == pytest.approx(100 * (2 * np.abs(e) / (np.abs(pn) + np.abs(tn) + 1e-7)).mean(), rel=1e-9)
            if spec.is_rate:
                ok = np.abs(tn) > 1e-7
                assert r.mape == pytest.approx(100 * np.abs(e[ok] / (tn[ok] + 1e-7)).mean(), rel=1e-9)
                assert r.log_likelihood is None
            else:
                pc, tc = np.clip(pn, 1e-7, 1 - 1e-7), np.clip(tn, 1e-7, 1 - 1e-7)
                assert r.log_likelihood == pytest.approx((np.log(pc) * tc + np.log(1 - pc) * (1 - tc)).mean(), rel=1e-9)
                assert r.mape is None


def test_result_does_not_depend_on_partitioning(spark, facts):
    spec = small.SPEC
    columns = [*PAIR, "timesteps", *spec.feature_columns, "y"]
    first = pipeline.prepare(facts, spec).features().select(*columns).toPandas()
    other = pipeline.prepare(facts.repartition(7, "timesteps"), spec).features().select(*columns).toPandas()
    same(first, other, [*PAIR, "timesteps"])


def test_test_rows_do_not_reach_the_scaler_or_the_model(spark, facts):
    from panelcast.operators import forecast

    spec = small.SPEC
    panel = pipeline.prepare(facts, spec)
    test_params = [r[0] for r in panel.outline.filter("split <> 'train'").select("parameter_index").distinct().collect()]
    is_other = F.col("parameter_index").isin(test_params)
    # counts of whole windows keep their sums above the threshold, so the split stays the same
    changed = facts.withColumn("a", F.when(is_other, F.col("a") * 100 + 7).otherwise(F.col("a"))).withColumn(
        "hits", F.when(is_other, F.col("tests")).otherwise(F.col("hits")))
    other = pipeline.prepare(changed, spec)
    kept = {r[0] for r in panel.outline.select("parameter_index").distinct().collect()}
    assert kept == {r[0] for r in other.outline.select("parameter_index").distinct().collect()}
    assert panel.scaler.collect() == other.scaler.collect()
    fits = [forecast.fit("linear", p.features(), spec, regParam=0.01) for p in (panel, other)]
    np.testing.assert_allclose(fits[0].coefficients.toArray(), fits[1].coefficients.toArray(), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("mode", ["prevalence", "cases"])
def test_default_columns_and_calendar(spark, mode, tmp_path):
    """Twelve covariates, twelve years of days, weekly windows: the settings nobody changed."""
    spec = PanelSpec(mode=mode)
    rng = np.random.default_rng(3)
    days = np.arange(1, 12 * 365 + 1)
    parts = []
    for param in range(8):
        covariates = dict(zip(spec.statics, rng.random(12)))
        for sim in range(2):
            n = rng.integers(200, 400, len(days))
            parts.append(pd.DataFrame({
                "parameter_index": param, "simulation_index": sim, "global_index": param * 2 + sim, "timesteps": days,
                "n_detect_lm_0_1825": rng.binomial(n, 0.2).astype(float), "n_age_0_1825": n.astype(float),
                "n_inc_clinical_0_36500": rng.poisson(3, len(days)).astype(float), "n_age_0_36500": n * 5.0,
                **covariates,
            }))
    table = pd.concat(parts, ignore_index=True)
    table.to_parquet(tmp_path / "facts.parquet")
    panel = pipeline.prepare(read_facts(spark, str(tmp_path / "facts.parquet"), spec), spec)
    rows = brute.keep(brute.windows(table, spec), spec)
    label = brute.labels(rows.parameter_index, spec)
    columns = [*PAIR, "split", "timesteps", "abs_timesteps", *spec.feature_columns, "y", "w"]
    assert len(spec.feature_columns) == spec.input_size == 15
    same(panel.features().select(*columns).toPandas(), brute.features(rows, label, spec), [*PAIR, "timesteps"])
