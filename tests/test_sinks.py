"""Round trips of everything that is saved."""

import math
from pathlib import Path

import pytest
import small
from pyspark.sql import functions as F

from panelcast.operators import forecast, losses, metrics, report, runs, sequences, split, tuning
from panelcast.plans import pipeline
from panelcast.sources import facts as fact_source
from panelcast.sources import records, stage

SPEC = small.SPEC


@pytest.fixture(scope="module")
def panel(spark):
    return pipeline.prepare(spark.createDataFrame(small.facts()), SPEC)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fact_scan_reads_only_named_columns(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.createDataFrame(small.facts()).withColumn("unused", F.lit("x")).write.parquet(path)
    got = fact_source.read_facts(spark, path, SPEC)
    assert got.columns == [*SPEC.unit, "timesteps", "hits", "tests", *SPEC.statics]
    got.createOrReplaceTempView("simulation_results")
    table = fact_source.read_fact_table(spark, "simulation_results", SPEC)
    assert table.schema == got.schema and table.exceptAll(got).isEmpty() and got.exceptAll(table).isEmpty()


def test_split_is_saved_then_reused(spark, tmp_path, panel):
    path = str(tmp_path / "split")
    facts = spark.createDataFrame(small.facts())
    first = pipeline.prepare(facts, SPEC, saved_split=path)
    table = split.split_table(first.outline, SPEC)
    assert rows(records.read_split(spark, path, SPEC)) == rows(table)
    again = pipeline.prepare(facts, SPEC.with_(seed=5), saved_split=path, reuse_split=True)
    assert rows(split.split_table(again.outline, SPEC)) == rows(table)
    path = str(tmp_path / "plain")  # a folder that was not written as versions, and whose writing broke off
    table.write.option("header", True).csv(path)
    (tmp_path / "plain" / "_SUCCESS").unlink()
    fresh = pipeline.prepare(facts, SPEC.with_(seed=5), saved_split=path, reuse_split=True)
    assert rows(split.split_table(fresh.outline, SPEC)) != rows(table)
    assert rows(records.read_split(spark, path, SPEC)) == rows(split.split_table(fresh.outline, SPEC))
    unasked = pipeline.prepare(facts, SPEC, saved_split=path)
    assert rows(split.split_table(unasked.outline, SPEC)) == rows(table) == rows(records.read_split(spark, path, SPEC))


def test_a_saved_split_with_overlap_is_refused(spark, tmp_path, panel):
    path = str(tmp_path / "split")
    table = split.split_table(panel.outline, SPEC)
    records.write_split(table.unionByName(table.withColumn("split", F.lit("test"))), path, SPEC)
    with pytest.raises(ValueError, match="more than one split"):
        pipeline.prepare(spark.createDataFrame(small.facts()), SPEC, saved_split=path, reuse_split=True)


def test_split_written_with_decimal_ids(spark, tmp_path):
    path = tmp_path / "split.csv"
    path.write_text("parameter_index,simulation_index,global_index,split\n1,2,12.0,train\n3,4,9007199254740993,test\n")
    assert rows(records.read_split(spark, str(path), SPEC)) == [(1, 2, 12, "train"), (3, 4, 9007199254740993, "test")]


def test_scaler(spark, tmp_path, panel):
    path = str(tmp_path / "scaler")
    records.write_scaler(panel.scaler, path)
    records.write_scaler(panel.scaler, path)
    saved = records.read_scaler(spark, path, SPEC)
    assert saved.collect() == panel.scaler.collect()
    assert saved.first().std_b == 1.0  # constant covariate


def test_metrics_and_comparison(spark, tmp_path, panel):
    path = str(tmp_path / "metrics")
    models = ["persistence", "seasonal"]
    record = metrics.metrics_record(pipeline.evaluation_rows(panel).filter("split = 'test'"), models, ["model"], SPEC)
    records.write_metrics(record.withColumn("mse", F.lit(9.0)), path, SPEC)
    records.write_metrics(record.withColumn("mse", F.lit(7.0)), path, SPEC.with_(mode="cases"))
    for model in models:
        records.write_metrics(record.filter(F.col("model") == model), path, SPEC)
    saved = records.read_metrics(spark, path)
    assert saved.filter("mode = 'cases' and mse = 7.0").count() == 2
    saved = saved.filter("mode = 'prevalence'")
    assert rows(saved.select(record.columns)) == rows(record)
    assert rows(metrics.compare_models(saved, models)) == rows(metrics.compare_models(record, models))


def test_history_trials_and_best_parameters(spark, tmp_path):
    history = spark.createDataFrame([("linear", 0, 1, 0.5, 0.25)], forecast.HISTORY_SCHEMA)
    records.write_history(history.limit(0), str(tmp_path / "history"))
    records.write_history(history, str(tmp_path / "history"))
    assert rows(records.read_history(spark, str(tmp_path / "history"))) == rows(history)

    trials = spark.createDataFrame(
        [(0, "linear", {"regParam": 0.1}, 0.5, 1, "COMPLETE"), (1, "linear", {"regParam": 0.2}, math.inf, None, "FAIL"),
         (0, "boosted", {"maxDepth": 3.0}, 0.7, 4, "COMPLETE")], tuning.TRIAL_SCHEMA)
    path = str(tmp_path / "trials")
    records.write_trials(trials.filter("trial_number = 0"), path)
    records.write_trials(trials, path)
    assert rows(records.read_trials(spark, path).select(trials.columns)) == rows(trials)

    best = runs.best_trial(trials)
    combined, single = str(tmp_path / "best"), str(tmp_path / "linear")
    own = {"linear": single}
    models = ["linear", "boosted"]

    def load():
        found = records.read_best_params(spark, models, combined, own)
        return {r.model_type: r.hyperparameters for r in found.collect()}

    assert load() == {"linear": None, "boosted": None}
    best.filter("model_type = 'linear'").write.json(single)
    assert load() == {"linear": {"regParam": 0.1}, "boosted": None}
    records.write_best_params(best.filter("model_type = 'boosted'"), combined)
    assert load() == {"linear": {"regParam": 0.1}, "boosted": None}  # combined lacks one model
    records.write_best_params(best.filter("model_type = 'linear'").withColumn(
        "hyperparameters", F.create_map(F.lit("regParam"), F.lit(9.0))), combined)
    assert load() == {"linear": {"regParam": 9.0}, "boosted": {"maxDepth": 3.0}}


def test_tune_fit_and_compare(spark, tmp_path, panel):
    found, record, table = pipeline.tune_fit_compare(panel, trials=2, parallel_trials=2, lookbacks=(4, 5))
    assert found.count() == 4 and found.filter("state = 'COMPLETE' and best_epoch >= 1").count() == 4
    assert {r.model for r in record.collect()} == set(forecast.FAMILIES)
    assert table.columns[-2:] == ["linear_prediction", "boosted_prediction"]
    n_steps = panel.outline.agg(F.sum("n_valid")).first()[0]
    assert table.count() == n_steps
    assert table.filter("linear_prediction is null or boosted_prediction is null").isEmpty()
    path = str(tmp_path / "table")
    records.write_actual_vs_predicted(table.limit(1), path)
    records.write_actual_vs_predicted(table, path)
    saved = records.read_actual_vs_predicted(spark, list(forecast.FAMILIES), path, SPEC)
    assert saved.columns == table.columns and saved.count() == n_steps


def test_failing_candidates_score_infinity(spark, panel):
    features = stage.stage(pipeline.features_with_windows(panel, (5000,)), "features")
    found = tuning.search(features, SPEC, families=("linear",), trials=1, lookbacks=(5000,)).first()
    assert found.best_val_loss == math.inf and found.state == "FAIL" and found.best_epoch is None
    late = tuning.search(features, SPEC, trials=2, timeout=-1.0)
    assert {(r.state, r.best_val_loss) for r in late.collect()} == {("SKIPPED", math.inf)} and late.count() == 4


def test_history_is_of_the_loss_that_ranks_trials(spark, panel):
    features = stage.stage(pipeline.features_with_windows(panel, (SPEC.lookback,)), "features")
    batched = sequences.batched_steps(features, SPEC, tuning.numbered(SPEC.lookback))
    for family, params, n in (("boosted", {"maxIter": 4, "seed": 1}, 4), ("linear", {}, 1)):
        model = forecast.fit(family, features, SPEC, **params)
        history = forecast.history(model, family, batched, SPEC).orderBy("epoch").collect()
        assert [r.epoch for r in history] == list(range(1, n + 1))
        whole = losses.mean_batch_loss(forecast.predict({family: model}, batched, SPEC), [family], ["split"], SPEC)
        last = {r.split: r.mean_batch_loss for r in whole.collect()}
        assert history[-1].val_loss == pytest.approx(last["validate"], rel=1e-9)
        assert history[-1].train_loss == pytest.approx(last["train"], rel=1e-9)
        candidate = tuning.Candidate(0, family, SPEC.lookback, params)
        _, _, _, loss, epoch, state = tuning.run_trial(candidate, features, SPEC)
        best = min(history, key=lambda r: (r.val_loss, r.epoch))
        assert (state, epoch) == ("COMPLETE", best.epoch) and loss == pytest.approx(best.val_loss, rel=1e-9)


def test_nothing_staged_stays_behind(spark):
    folder = Path(stage.staging_folder(spark))
    before = {p.name for p in folder.iterdir()}
    with stage.staging_scope():
        panel = pipeline.prepare(spark.createDataFrame(small.facts()), SPEC)
        assert {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before} == {"windows", "series"}
        assert pipeline.evaluation_rows(panel).count() > 0
    assert {p.name for p in folder.iterdir()} == before


def test_a_staged_result_outlives_what_it_was_made_of(spark):
    folder = Path(stage.staging_folder(spark))
    before = {p.name for p in folder.iterdir()}
    with stage.staging_scope():
        result = stage.staged_result(spark, "result", lambda: stage.stage(spark.range(4), "part").union(spark.range(2)))
        assert [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before] == ["result"]
        assert result.count() == 6
    assert {p.name for p in folder.iterdir()} == before


def test_without_a_shared_folder_tables_are_cached(spark, monkeypatch):
    monkeypatch.setattr(stage, "staging_folder", lambda _: None)
    with stage.staging_scope():
        staged = stage.stage(spark.range(5), "cached")
        assert staged.count() == 5 and staged.is_cached
    assert not staged.is_cached


def test_fitting_copies_equals_fitting_with_coverage(spark, panel):
    """The coverage weight stands for the overlapping windows a step is in."""
    features = stage.stage(panel.features(), "features")
    weighted = forecast.training_rows(features, SPEC)
    copies = weighted.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("fit_weight").cast("int")))).withColumn(
        "fit_weight", F.lit(1.0))
    a, b = (forecast.create_model("linear", regParam=0.1, solver="normal").fit(d) for d in (weighted, copies))
    assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), rel=1e-8, abs=1e-10)


def test_report_of_rates_is_by_day(spark):
    spec = SPEC.with_(mode="cases", min_cases=20.0)
    panel = pipeline.prepare(spark.createDataFrame(small.facts()), spec)
    table = report.actual_vs_predicted(panel.features().withColumn("yhat_same", F.col("y")), ["same"], spec)
    assert table.filter("abs(true_cases - same_prediction) > 1e-9").isEmpty()
    assert table.agg(F.min("timestep")).first()[0] >= spec.burn_in


def test_staging_leaves_no_shuffle_files_and_no_setting(spark):
    from panelcast.sources import stage as staging

    before = spark.conf.get(staging._FREES_SHUFFLES, None)
    with staging.staging_scope():
        seen = staging.stage(spark.range(1_000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
        assert sorted(map(tuple, seen.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(staging._FREES_SHUFFLES, None) == before and staging._freeing["writes"] == 0
