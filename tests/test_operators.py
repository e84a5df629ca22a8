"""Hand-sized cases and properties of single operators."""

import math

import numpy as np
import pytest
import small
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.functions import calendar, targets
from panelcast.operators import losses, metrics, ordinals, outline, report, runs, sampling, split, windows
from panelcast.operators.forecast import create_model
from panelcast.spec import PanelSpec

SPEC = small.SPEC
slow = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df):
    return [tuple(r) for r in df.collect()]


def facts_of(spark, rows):
    """(param, sim, global, day, hits, tests) rows."""
    schema = "parameter_index bigint, simulation_index bigint, global_index bigint, timesteps bigint, hits double, tests double"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(5.0)).withColumn("c", F.lit(2.0))


# spec

def test_spec_rejects_unknown_modes():
    with pytest.raises(ValueError):
        PanelSpec(mode="other")
    with pytest.raises(ValueError):
        PanelSpec(loss_space="other")
    with pytest.raises(ValueError):
        PanelSpec(lookback=0)


def test_input_size_counts_time_covariates_and_event_features():
    assert PanelSpec().input_size == 1 + 12 + 2
    assert PanelSpec(cyclic_time=True).input_size == 2 + 12 + 2


# targets

@slow
@given(st.lists(st.floats(-0.5, 1.5), min_size=1, max_size=20))
def test_prevalence_round_trip_is_the_clip(spark, ys):
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    back = targets.inverse(targets.transform(F.col("y"), SPEC), SPEC)
    for y, b in values(df.select("y", back)):
        assert b == pytest.approx(min(max(y, 1e-5), 1 - 1e-5), rel=1e-9)


@slow
@given(st.lists(st.floats(-10, 1e6), min_size=1, max_size=20))
def test_rate_round_trip_floors_at_zero(spark, ys):
    spec = SPEC.with_(mode="cases")
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    back = targets.inverse(targets.transform(F.col("y"), spec), spec)
    for y, b in values(df.select("y", back)):
        assert b == pytest.approx(max(y, 0.0), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("mode", ["prevalence", "cases"])
def test_null_targets_stay_null(spark, mode):
    spec = SPEC.with_(mode=mode)
    df = spark.createDataFrame([(None,)], "y double")
    assert values(df.select(targets.transform(F.col("y"), spec))) == [(None,)]


# calendar

def test_event_features_at_the_intervention_day(spark):
    df = spark.createDataFrame([(59,), (60,), (425,)], "d bigint")
    got = values(df.select(calendar.post_intervention(F.col("d"), SPEC), calendar.years_since(F.col("d"), SPEC)))
    assert got == [(0, 0.0), (1, 0.0), (1, 1.0)]


def test_time_norm_of_a_single_step_is_the_step(spark):
    df = spark.createDataFrame([(3, 3, 3), (1, 1, 5), (5, 1, 5), (2, 1, 5)], "s bigint, a bigint, b bigint")
    assert [r[0] for r in values(df.select(calendar.time_norm(F.col("s"), F.col("a"), F.col("b"))))] == [3.0, 0.0, 1.0, 0.25]


# windows

def test_window_edges_and_zero_denominators(spark):
    facts = facts_of(spark, [
        (1, 1, 11, 9, 1.0, 1.0),                            # burn-in
        (1, 1, 11, 10, 1.0, 4.0), (1, 1, 11, 14, 0.0, 0.0),  # ratio of sums over a day without tests
        (1, 1, 11, 15, 0.0, 0.0),                            # window without tests: dropped
        (1, 1, 11, 20, 3.0, 4.0),                            # partial window: kept
    ])
    rows = windows.panel_windows(facts, SPEC)
    got = rows.select("group_id", "abs_timesteps", "prevalence").orderBy("group_id")
    assert values(got) == [(0, 10, 0.25), (2, 20, 0.75)]
    staged = windows.stage_windows(facts, SPEC)
    steps = windows.with_steps(staged, outline.chunk_outline(staged, SPEC), SPEC)
    assert sorted(values(steps.select("group_id", "timesteps"))) == [(0, 1), (2, 2)]


def test_row_rate_without_exposure_is_null(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 4.0)], "events double, person_days double")
    assert [r.raw_cases for r in windows.row_rate(df, SPEC.with_(mode="cases")).collect()] == [None, 500.0]


def test_covariates_from_a_table_by_parameter_equal_those_in_the_facts(spark):
    facts = spark.createDataFrame(small.facts())
    statics = facts.select("parameter_index", *SPEC.statics).distinct()
    wide = outline.chunk_outline(windows.stage_windows(facts, SPEC), SPEC)
    narrow_windows = windows.stage_windows(facts.drop(*SPEC.statics), SPEC)
    narrow = outline.chunk_outline(narrow_windows, SPEC, statics)
    pick = ["parameter_index", "simulation_index", "chunk", "fit_statics", "statics"]
    valid = wide.filter("valid_length > 0").select(pick)
    assert sorted(values(valid), key=str) == sorted(values(narrow.filter("valid_length > 0").select(pick)), key=str)
    with pytest.raises(ValueError):
        outline.chunk_outline(narrow_windows, SPEC)


# sampling

def test_sample_takes_k_and_ignores_extra_global_ids(spark):
    rows = [(p, s, p * 100 + s * 10 + g, 12, 1.0, 2.0) for p in range(5) for s in range(6) for g in range(1 + s % 2)]
    facts = facts_of(spark, rows)
    spec = SPEC.with_(sims_per_param=4)
    got = values(sampling.sample_units(facts, spec))
    assert len(got) == len(set(got)) == 20
    assert values(sampling.sample_units(facts.repartition(7), spec).orderBy(*SPEC.pair)) == sorted(got)
    other = values(sampling.sample_units(facts, spec.with_(seed=1)))
    assert set(other) != set(got)
    kept = sampling.keep_units(facts, sampling.sample_units(facts, spec), spec)
    assert kept.count() == facts.filter(F.concat_ws("-", *SPEC.pair).isin([f"{p}-{s}" for p, s in got])).count()


def test_a_sample_gives_equal_rows_whether_it_is_broadcast_or_not(spark):
    facts = spark.createDataFrame(small.facts())
    spec = SPEC.with_(sims_per_param=2, param_limit=102)
    sent = windows.panel_windows(facts, spec).collect()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = windows.panel_windows(facts, spec).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, sent)) == sorted(map(tuple, shuffled)) and sent
    assert max(r.parameter_index for r in sent) < 102


# ordinals

@slow
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 6))
def test_running_total_is_exact(spark, weights, parts):
    df = spark.createDataFrame(list(enumerate(weights)), "k bigint, v bigint").repartition(parts)
    got = {r.k: (r.b, r.t) for r in ordinals.running_total(df, ["k"], F.col("v"), "b", "t").collect()}
    ends = np.cumsum(weights)
    assert got == {k: (ends[k] - weights[k], ends[-1]) for k in range(len(weights))}


@slow
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 5)), min_size=1, max_size=40), st.integers(1, 6))
def test_total_within_groups_is_exact(spark, rows, parts):
    df = spark.createDataFrame([(k, g, v) for k, (g, v) in enumerate(rows)], "k bigint, g string, v bigint")
    got = {r.k: r.b for r in ordinals.total_within(df.repartition(parts), "g", ["k"], F.col("v"), "b").collect()}
    assert got == {k: sum(v for h, v in rows[:k] if h == g) for k, (g, _) in enumerate(rows)}


# split

@slow
@given(st.integers(1, 60))
def test_split_shares_are_exact(spark, n):
    labels = dict(values(split.split_params(spark.range(n).withColumnRenamed("id", "parameter_index"), SPEC)))
    counts = [list(labels.values()).count(s) for s in ("train", "validate", "test")]
    a, b = int(0.7 * n), int(0.15 * n)
    assert counts == [a, b, n - a - b] and len(labels) == n


def test_overlap_is_found_and_raises_with_five_examples(spark):
    table = spark.createDataFrame(
        [(p, s, p * 10 + s, label) for p in range(4) for s in range(2) for label in ("train", "test")],
        "parameter_index bigint, simulation_index bigint, global_index bigint, split string",
    )
    with pytest.raises(ValueError) as error:
        split.verify_split(table, SPEC)
    assert "8 series" in str(error.value) and str(error.value).count("(") == 5
    healthy = table.filter("split = 'train'")
    assert split.split_overlap(healthy, SPEC).isEmpty()
    split.verify_split(healthy.unionByName(healthy), SPEC)


def test_saved_split_keeps_known_labels_of_present_series(spark):
    saved = spark.createDataFrame(
        [(1, 1, 11, "train"), (1, 2, 12, "train"), (2, 1, 21, "other"), (9, 9, 99, "test")],
        "parameter_index bigint, simulation_index bigint, global_index bigint, split string",
    )
    present = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, True)],
                                    "parameter_index bigint, simulation_index bigint, is_first boolean")
    assert values(split.restrict_split(saved, present, SPEC)) == [(1, 1, 11, "train")]


# losses and metrics

def scored(spark, rows):
    schema = "parameter_index bigint, simulation_index bigint, start bigint, position bigint, y double, yhat_m double, w double, batch_id bigint"
    return spark.createDataFrame([(1, 1, 0, i, *r, 0) for i, r in enumerate(rows)], schema)


def test_total_weight_is_at_least_one(spark):
    rows = scored(spark, [(0.0, 1.0, 0.1), (0.0, 2.0, 0.2)])
    got = losses.level_loss(rows, ["m"], ["model"], SPEC, "transformed").first().base_loss
    assert got == pytest.approx(0.1 * 1 + 0.2 * 4)


def test_window_of_one_step_has_no_shape_terms(spark):
    r = losses.shape_loss(scored(spark, [(0.0, 1.0, 2.0)]), ["m"], ["model"], SPEC, "transformed").first()
    assert (r.base_loss, r.slope_loss, r.curvature_loss, r.total_loss) == (1.0, 0.0, 0.0, 1.0)


def test_curvature_is_off_without_weight(spark):
    rows = scored(spark, [(0.0, 1.0, 1.0), (0.0, 0.0, 1.0), (0.0, 5.0, 1.0)])
    r = losses.shape_loss(rows, ["m"], ["model"], SPEC.with_(curvature_weight=0.0), "transformed").first()
    assert r.curvature_loss == 0.0 and r.slope_loss > 0


@pytest.mark.parametrize("pairs, r2", [
    ([(0.3, 0.3), (0.3, 0.3)], 1.0),
    ([(0.3, 0.3), (0.3, 0.9)], 0.0),
    ([(0.3, 0.3)], None),
])
def test_r2_of_a_constant_target(spark, pairs, r2):
    rows = scored(spark, [(y, p, 1.0) for y, p in pairs])
    assert metrics.metrics_record(rows, ["m"], ["model"], SPEC).first().r2 == r2


def test_comparison_has_a_column_per_model(spark):
    records = spark.createDataFrame([("x", 1.0, 1.0, 1.0, 0.5)], "model string, mse double, rmse double, mae double, r2 double")
    got = {r.metric: (r.x, r.z) for r in metrics.compare_models(records, ["x", "z"]).collect()}
    assert got == {"mse": (1.0, None), "rmse": (1.0, None), "mae": (1.0, None), "r2": (0.5, None)}


def test_two_records_of_one_model_are_an_error(spark):
    schema = "model string, mse double, rmse double, mae double, r2 double"
    records = spark.createDataFrame([("x", 1.0, 1.0, 1.0, 0.5), ("x", 2.0, 1.0, 1.0, 0.5)], schema)
    with pytest.raises(Exception, match="two records"):
        metrics.compare_models(records, ["x"]).collect()


# runs

def expected_run(series, patience):
    """An epoch improves if its loss is finite and below every earlier finite loss; a run stops at the first
    epoch that has ``patience`` epochs since the last improving one, or since the start, behind it."""
    gains = [e for e, v in enumerate(series, start=1)
             if math.isfinite(v) and all(v < u for u in series[:e - 1] if math.isfinite(u))]
    stops = [e for e in range(1, len(series) + 1) if e - max([0, *[g for g in gains if g <= e]]) >= patience]
    stop = min(stops, default=len(series))
    best = max([g for g in gains if g <= stop], default=None)
    return stop, bool(stops), None if best is None else series[best - 1], best


LOSSES = st.sampled_from([0.0, 1.0, 2.0, 3.0, 4.0, math.inf, math.nan])


@slow
@given(st.lists(st.lists(LOSSES, min_size=1, max_size=12), min_size=1, max_size=4), st.integers(1, 4))
def test_early_stopping(spark, series, patience):
    history = spark.createDataFrame(
        [(i, e, float(v)) for i, s in enumerate(series) for e, v in enumerate(s, start=1)],
        "run bigint, epoch bigint, val_loss double",
    )
    got = {r.run: (r.stop_epoch, r.stopped_early, r.best_val_loss, r.best_epoch)
           for r in runs.run_report(history, ["run"], patience).collect()}
    assert got == {i: expected_run(s, patience) for i, s in enumerate(series)}
    best = {r.run: r.best_epoch for r in runs.best_epoch(history, ["run"]).collect()}
    numbers = [[math.inf if math.isnan(v) else v for v in s] for s in series]
    assert all(best[i] == s.index(min(s)) + 1 for i, s in enumerate(numbers) if math.isfinite(min(s)))


def test_failed_trials_come_last_and_ties_go_to_the_earlier(spark):
    trials = spark.createDataFrame(
        [("linear", 0, math.inf), ("linear", 1, 0.5), ("linear", 2, 0.5)],
        "model_type string, trial_number bigint, best_val_loss double",
    )
    assert runs.best_trial(trials).first().trial_number == 1
    assert [r.trial_number for r in runs.leaderboard(trials).orderBy("rank").collect()] == [1, 2, 0]


def test_tuned_beats_loaded_beats_default(spark):
    def table(*rows):
        return spark.createDataFrame(rows, "model_type string, p double, q double")

    got = runs.choose_parameters(
        table(("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0)),
        table(("a", 2.0, None), ("b", 2.0, 2.0)), table(("a", 3.0, None)), ["p", "q"],
    )
    assert sorted(values(got)) == [("a", "tuned", 3.0, None), ("b", "loaded", 2.0, 2.0), ("c", "default", 1.0, 1.0)]


# reports

def test_report_takes_a_test_series_where_there_is_one(spark):
    pairs = "parameter_index bigint, simulation_index bigint"
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 4), (2, 3), (3, 0)], pairs)
    tests = spark.createDataFrame([(1, 2), (1, 1)], pairs)
    params = spark.createDataFrame([(1,), (2,)], "parameter_index bigint")
    got = report.report_series(rows, tests, params, SPEC)
    assert sorted(values(got)) == [(1, 1, True), (2, 3, False)]


def test_at_most_nine_parameters_are_shown(spark):
    series = spark.range(30).select(F.col("id").alias("parameter_index"), F.lit("test").alias("split"))
    assert report.report_params(series, SPEC).count() == 9
    assert report.report_params(series.limit(4), SPEC).count() == 4


def test_unknown_model_family():
    with pytest.raises(ValueError):
        create_model("forest")


def test_series_rank_equals_a_plain_window(spark):
    rows = windows.stage_windows(spark.createDataFrame(small.facts()), SPEC)
    steps = windows.with_steps(rows, outline.chunk_outline(rows, SPEC), SPEC)
    plain = F.row_number().over(Window.partitionBy(*SPEC.pair).orderBy("group_id", "global_index"))
    assert steps.withColumn("plain", plain).filter("plain <> timesteps").isEmpty()
