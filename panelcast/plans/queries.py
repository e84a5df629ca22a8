"""Registered queries: each operator over the whole star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.operators import (
    baselines, features, forecast, losses, metrics, outline, recurrent, report, runs, sampling, scale, sequences,
    shuffling, split, tuning, windows,
)
from panelcast.operators.shape_fit import fit_shape as fit_on_shape
from panelcast.plans import pipeline
from panelcast.sources import by_series, ordered, records
from panelcast.sources.facts import select_facts
from panelcast.sources.lineitem import LINEITEM_SPEC, SAMPLED_SPEC, lineitem_facts, supplier_statics
from panelcast.sources.stage import stage, staging_folder
from panelcast.spec import PanelSpec

PREVALENCE = LINEITEM_SPEC
CASES = LINEITEM_SPEC.with_(mode="cases", slope_weight=0.1, curvature_weight=0.05)
KEYS = ["parameter_index", "simulation_index"]
PARAM_LIMIT = 40
ORDERED_RANGE = (3, 60)
#: Weekly windows, so that series reach all look-backs of a search.
TUNED = LINEITEM_SPEC.with_(window=7)
SHAPE = LINEITEM_SPEC.with_(slope_weight=0.5, curvature_weight=0.25, loss_space="transformed")
NATURAL_SHAPE = SHAPE.with_(loss_space="natural")
#: Chunks of eight windows, so that series span many.
STATEFUL = LINEITEM_SPEC.with_(chunk=8)
STATE_DECAYS = (0.8, 0.3)
EPOCHS = 2
RIDGE = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)
HISTORY_START = "2024-01-01"
EVENT_COLUMNS = "ts timestamp_ntz, user_id bigint, event_type string, value double"
DEFAULT_PARAMETERS = {"learning_rate": 0.001, "lookback": 30}


def rounded(column: str | Column, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def round_doubles(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, so that results compare across engines."""
    return df.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def panel(spark: SparkSession, d: str, spec: PanelSpec = PREVALENCE) -> pipeline.Panel:
    facts = lineitem_facts(spark, d, spec, after_burn_in=True)
    statics, population = supplier_statics(spark, d, spec), lineitem_facts(spark, d, spec)
    return pipeline.prepare(facts, spec, statics, population=population)


def staged_windows(spark: SparkSession, d: str, spec: PanelSpec = PREVALENCE) -> DataFrame:
    facts = lineitem_facts(spark, d, spec, after_burn_in=True)
    return windows.stage_windows(facts, spec, lineitem_facts(spark, d, spec))


def series_of(rows: DataFrame, spark: SparkSession, d: str, spec: PanelSpec = PREVALENCE) -> DataFrame:
    return outline.chunk_outline(rows, spec, supplier_statics(spark, d, spec))


def kept(spark: SparkSession, d: str, spec: PanelSpec = PREVALENCE) -> DataFrame:
    return pipeline.kept_outline(staged_windows(spark, d, spec), spec, supplier_statics(spark, d, spec))


def labelled(spark: SparkSession, d: str, spec: PanelSpec = PREVALENCE) -> DataFrame:
    return pipeline.label_outline(kept(spark, d, spec), spec)


# sources, filters, sampling

def scan_panel(spark, d):
    facts = lineitem_facts(spark, d)
    wide = facts.join(supplier_statics(spark, d), "parameter_index")
    return wide.select(*facts.columns, *PREVALENCE.statics)


def param_limit(spark, d):
    spec = PREVALENCE.with_(param_limit=PARAM_LIMIT)
    return sampling.limit_params(lineitem_facts(spark, d), spec).select(*KEYS, "timesteps", "total_qty")


def distinct_units(spark, d):
    return sampling.distinct_units(lineitem_facts(spark, d), PREVALENCE)


def sample_units(spark, d):
    return sampling.sample_units(lineitem_facts(spark, d), SAMPLED_SPEC)


def semi_join_sample(spark, d):
    facts = lineitem_facts(spark, d)
    rows = sampling.sampled(facts, SAMPLED_SPEC)
    return rows.select(*KEYS, "global_index", "timesteps", "returned_qty", "total_qty")


def row_rate(spark, d):
    rows = windows.row_rate(lineitem_facts(spark, d), CASES)
    return rows.select(*KEYS, "timesteps", rounded("raw_cases").alias("raw_cases"))


# windows

def _windows(spark, d, spec):
    facts = lineitem_facts(spark, d, spec, after_burn_in=True)
    rows = windows.panel_windows(facts, spec)
    rows = windows.attach_statics(rows, supplier_statics(spark, d, spec), list(spec.statics), spec)
    return rows.select(*spec.unit, "group_id", "abs_timesteps", *spec.measures, *spec.statics)


def window_prevalence(spark, d):
    return _windows(spark, d, PREVALENCE)


def window_rate(spark, d):
    return round_doubles(_windows(spark, d, CASES))


def renumber(spark, d):
    rows = staged_windows(spark, d)
    steps = windows.with_steps(rows, series_of(rows, spark, d), PREVALENCE)
    return steps.select(*KEYS, "global_index", "group_id", "timesteps", "abs_timesteps")


def renumber_by_series(spark, d):
    """Steps of sampled series from facts kept by series: summed, numbered and joined in their buckets."""
    spec, buckets = SAMPLED_SPEC, int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = by_series.with_chunks(lineitem_facts(spark, d, spec), spec, buckets)
    facts = stage(facts, "facts", by_series.layout_of(facts, spec))
    rows = windows.stage_windows(select_facts(facts, spec), spec)
    series = outline.chunk_outline(rows, spec, supplier_statics(spark, d, spec))
    steps = windows.with_steps(rows, stage(series, "outline", by_series.layout_of(series, spec)), spec)
    return steps.select(*KEYS, "global_index", "group_id", "timesteps", "abs_timesteps")


def threshold_filter(spark, d):
    rows = staged_windows(spark, d)
    series = outline.above_threshold(series_of(rows, spark, d), PREVALENCE)
    mean = series.select(*KEYS, "chunk", rounded("mean_target").alias("mean_target"))
    return rows.join(mean, [*KEYS, "chunk"]).select(*KEYS, "group_id", "prevalence", "mean_target")


def series_outline(spark, d):
    series = outline.one_per_series(kept(spark, d))
    first = [F.col(f"fit_statics.{c}").alias(c) for c in PREVALENCE.statics]
    return series.select(*KEYS, "global_index", F.col("length").alias("n_steps"), "min_step", "max_step", *first)


# split and scale

def split_params(spark, d):
    return split.split_params(kept(spark, d), PREVALENCE)


def split_series(spark, d):
    return split.split_table(labelled(spark, d), PREVALENCE)


def split_sizes(spark, d):
    return split.split_sizes(split.split_table(labelled(spark, d), PREVALENCE), PREVALENCE)


def split_overlap(spark, d):
    """The split table with every test series entered again as training."""
    table = split.split_table(labelled(spark, d), PREVALENCE)
    doctored = table.unionByName(table.filter("split = 'test'").withColumn("split", F.lit("train")))
    return split.split_overlap(doctored, PREVALENCE)


def split_restrict(spark, d):
    """A split saved over all series, restricted to the series of a sampled run."""
    facts = lineitem_facts(spark, d)
    units = sampling.distinct_units(facts, PREVALENCE)
    saved = split.split_series(units, split.split_params(units, PREVALENCE), PREVALENCE)
    return split.restrict_split(saved, kept(spark, d, SAMPLED_SPEC), PREVALENCE).select(*KEYS, "split")


def scaler_stats(spark, d):
    return round_doubles(scale.fit_scaler(labelled(spark, d), PREVALENCE))


# features and targets

def _features(spark, d, columns, spec=PREVALENCE):
    rows = panel(spark, d, spec).features()
    return round_doubles(rows.select(*KEYS, "timesteps", *columns))


def gate_scale(spark, d):
    return _features(spark, d, ["abs_timesteps", *[f"scaled_{c}" for c in PREVALENCE.statics]])


def event_features(spark, d):
    return _features(spark, d, ["abs_timesteps", "post_intervention", "years_since"])


def cyclic_time(spark, d):
    return _features(spark, d, ["abs_timesteps", "sin_day", "cos_day"])


def norm_time(spark, d):
    return _features(spark, d, ["time_norm"], PREVALENCE.with_(cyclic_time=False))


def _joined(spark, d, spec):
    rows = staged_windows(spark, d, spec)
    series = outline.above_threshold(series_of(rows, spark, d, spec), spec).withColumn("split", F.lit("all"))
    return features.join_outline(rows, series, spec)


def target_logit(spark, d):
    y = targets.transform(F.col("prevalence"), PREVALENCE)
    return round_doubles(_joined(spark, d, PREVALENCE).select(*KEYS, "timesteps", "prevalence", y.alias("y")))


def target_log1p(spark, d):
    y = targets.transform(F.col("cases"), CASES)
    return round_doubles(_joined(spark, d, CASES).select(*KEYS, "timesteps", "cases", y.alias("y")))


def target_roundtrip(spark, d):
    parts = [
        _joined(spark, d, spec).select(
            F.lit(spec.mode).alias("mode"), *KEYS, "timesteps",
            targets.inverse(targets.transform(F.col(spec.target), spec), spec).alias("back"),
        )
        for spec in (PREVALENCE, CASES)
    ]
    return round_doubles(parts[0].unionByName(parts[1]))


def row_weights(spark, d):
    parts = [
        _joined(spark, d, spec).select(
            F.lit(spec.mode).alias("mode"), *KEYS, "timesteps",
            features.row_weight(spec).cast("double").alias("w"),
        )
        for spec in (PREVALENCE, CASES)
    ]
    return parts[0].unionByName(parts[1])


def panel_features(spark, d):
    """Flagship: every kept step with its split, features in model order, target and weight."""
    return _features(spark, d, ["split", *PREVALENCE.feature_columns, "y", "w"])


def panel_features_rate(spark, d):
    return _features(spark, d, ["split", *CASES.feature_columns, "y", "w"], CASES)


# look-back windows

def window_starts(spark, d):
    return sequences.window_starts(labelled(spark, d), PREVALENCE)


def window_rows(spark, d):
    arrays = sequences.window_arrays(panel(spark, d).features(), PREVALENCE)
    steps = arrays.select(*KEYS, "split", "start", F.posexplode(F.arrays_zip("x", "y", "w")).alias("k", "step"))
    x = {name: i for i, name in enumerate(PREVALENCE.feature_columns)}
    return round_doubles(steps.select(
        *KEYS, "split", "start", F.col("k").cast("bigint").alias("k"),
        F.col("step.x")[x["sin_day"]].alias("sin_day"),
        F.col("step.x")[x["years_since"]].alias("years_since"),
        F.col("step.y").alias("y"), F.col("step.w").alias("w"),
    ))


def batch_ids(spark, d):
    series = sequences.number_windows(labelled(spark, d), PREVALENCE)
    starts = sequences.window_starts(series, PREVALENCE, ("windows_before",))
    batch = sequences.batch_of(F.col("start"), sequences.stride(PREVALENCE), PREVALENCE)
    return starts.select(*KEYS, "split", "start", batch.alias("batch_id"))


def train_batches(spark, d):
    """Two epochs of shuffled training batches; the last one of each, if short, is left out."""
    series = sequences.number_windows(labelled(spark, d), PREVALENCE)
    return shuffling.train_batches(series, PREVALENCE, EPOCHS)


def coverage(spark, d):
    rows = panel(spark, d).features().filter("split = 'train'")
    return rows.select(*KEYS, "timesteps", sequences.coverage(PREVALENCE).cast("bigint").alias("n_windows"))


# losses and metrics

def _scored(spark, d, spec):
    return pipeline.evaluation_rows(panel(spark, d, spec))


def diffs(spark, d):
    rows = losses.with_differences(_scored(spark, d, CASES), baselines.BASELINES, CASES, "natural")
    return round_doubles(rows.select("model", *KEYS, "start", "position", "p1", "t1", "w1", "p2", "t2", "w2"))


def weighted_loss(spark, d):
    rows = _scored(spark, d, CASES)
    parts = [
        losses.level_loss(rows, baselines.BASELINES, ["model", "split"], CASES, space).withColumn("loss_space", F.lit(space))
        for space in ("natural", "transformed")
    ]
    return round_doubles(parts[0].unionByName(parts[1]))


def shape_loss(spark, d):
    spec = PREVALENCE.with_(curvature_weight=0.02)
    return round_doubles(losses.shape_loss(_scored(spark, d, spec), baselines.BASELINES, ["model", "split"], spec))


def batch_loss(spark, d):
    rows = _scored(spark, d, CASES)
    return round_doubles(losses.mean_batch_loss(rows, baselines.BASELINES, ["model", "split"], CASES))


def metrics_prevalence(spark, d):
    rows = _scored(spark, d, PREVALENCE)
    return round_doubles(metrics.metrics_record(rows, baselines.BASELINES, ["model", "split"], PREVALENCE).drop("mape"))


def metrics_rate(spark, d):
    rows = _scored(spark, d, CASES)
    return round_doubles(metrics.metrics_record(rows, baselines.BASELINES, ["model", "split"], CASES).drop("log_likelihood"))


def compare_models(spark, d):
    rows = _scored(spark, d, PREVALENCE).filter("split = 'test'")
    records = metrics.metrics_record(rows, baselines.BASELINES, ["model"], PREVALENCE)
    return round_doubles(metrics.compare_models(records, baselines.BASELINES))


# runs and trials

def run_history(spark, d):
    """Users stand for runs and days for epochs; the mean value is the loss."""
    events = spark.read.schema(EVENT_COLUMNS).parquet(f"{d}/events.parquet")
    epoch = F.datediff("ts", F.lit(HISTORY_START).cast("date")).cast("bigint")
    return events.groupBy(F.col("user_id").alias("run"), epoch.alias("epoch")).agg(
        rounded(F.avg("value"), 9).alias("val_loss")
    )


def trials(spark, d):
    """Event types stand for model families and users for trials."""
    events = spark.read.schema(EVENT_COLUMNS).parquet(f"{d}/events.parquet")
    return events.groupBy(F.col("event_type").alias("model_type"), F.col("user_id").alias("trial_number")).agg(
        rounded(F.avg("value"), 9).alias("best_val_loss"), F.count("*").alias("n_events")
    )


def best_epoch(spark, d):
    return runs.best_epoch(run_history(spark, d), ["run"])


def awkward_history(spark, d):
    """All runs, and each again under a negative name after an infinite loss and one that is not a number.

    Of those again, every third run never has a loss that is a number.
    """
    history = run_history(spark, d)
    loss = F.when(F.col("run") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("val_loss"))
    again = history.select((-1 - F.col("run")).alias("run"), "epoch", loss.alias("val_loss"))
    before = F.array(*[F.struct(F.lit(e).cast("bigint").alias("epoch"), F.lit(float(x)).alias("val_loss"))
                       for e, x in ((-2, "inf"), (-1, "nan"))])
    first = again.select("run").distinct().select("run", F.inline(before))
    return history.unionByName(again).unionByName(first)


def patience(spark, d):
    return runs.patience_counter(awkward_history(spark, d), ["run"])


def run_report(spark, d):
    return runs.run_report(awkward_history(spark, d), ["run"], PREVALENCE.patience)


def leaderboard(spark, d):
    return runs.leaderboard(trials(spark, d)).select("model_type", "trial_number", "best_val_loss", "rank")


def best_trial(spark, d):
    return runs.best_trial(trials(spark, d)).select("model_type", "trial_number", "best_val_loss")


def param_precedence(spark, d):
    """Defaults for every model, loaded for three of them, tuned for two."""
    best = runs.best_trial(trials(spark, d)).select(
        "model_type",
        rounded(F.col("best_val_loss") / 1000.0, 9).alias("learning_rate"),
        F.col("n_events").alias("lookback"),
    )
    defaults = trials(spark, d).select("model_type").distinct().select(
        "model_type",
        F.lit(DEFAULT_PARAMETERS["learning_rate"]).alias("learning_rate"),
        F.lit(DEFAULT_PARAMETERS["lookback"]).cast("bigint").alias("lookback"),
    )
    loaded = best.filter(F.col("model_type").isin("click", "signup", "purchase")).withColumn(
        "lookback", F.col("lookback") + 100
    )
    tuned = best.filter(F.col("model_type").isin("purchase", "view"))
    return runs.choose_parameters(defaults, loaded, tuned, ["learning_rate", "lookback"])


# reports

def report_params(spark, d):
    return report.report_params(labelled(spark, d), PREVALENCE)


def report_series(spark, d):
    rows = staged_windows(spark, d)
    kept_series = pipeline.kept_outline(rows, PREVALENCE, supplier_statics(spark, d))
    series = pipeline.label_outline(kept_series, PREVALENCE)
    chosen = report.report_params(series, PREVALENCE)
    return report.report_series(rows, report.test_series(series, PREVALENCE), chosen, PREVALENCE)


def actual_vs_pred(spark, d):
    """All kept series, every step."""
    rows = pipeline.baseline_rows(panel(spark, d))
    return round_doubles(report.actual_vs_predicted(rows, baselines.BASELINES, PREVALENCE))


def report_table(spark, d):
    """The series chosen for the report, every step."""
    whole = panel(spark, d)
    rows = lambda part: pipeline.baseline_rows(whole, part)
    return round_doubles(pipeline.report_table(whole, rows, baselines.BASELINES))


# models

def _features_for(spark, d, lookbacks=(PREVALENCE.lookback,), spec=PREVALENCE):
    return stage(pipeline.features_with_windows(panel(spark, d, spec), lookbacks), "features")


def fit_score(spark, d):
    """Fit both families on train and score every step of every kept series; boosting has no SQL form."""
    rows = _features_for(spark, d)
    parameters = {"linear": {"regParam": 0.01}, "boosted": {"seed": PREVALENCE.seed}}
    scored = forecast.predict(pipeline.fit_models(rows, PREVALENCE, parameters), rows, PREVALENCE)
    return forecast.natural_predictions(scored, list(parameters), PREVALENCE)


def _linear_scores(scored, model, spec):
    return round_doubles(forecast.natural_predictions(scored, [model], spec).drop("model", "global_index"))


def fit_score_linear(spark, d):
    """The linear family without a penalty, which has a closed form."""
    rows = _features_for(spark, d)
    models = pipeline.fit_models(rows, PREVALENCE, {"linear": {}})
    return _linear_scores(forecast.predict(models, rows, PREVALENCE), "linear", PREVALENCE)


def fit_shape(spark, d):
    """Fitted on level, slope and curvature of the training windows in transformed space."""
    rows = _features_for(spark, d, spec=SHAPE)
    model = fit_on_shape(rows, SHAPE)
    return _linear_scores(forecast.predict({"shape": model}, rows, SHAPE), "shape", SHAPE)


def fit_shape_natural(spark, d):
    """The same loss in natural space, by rounds of linearised fits; no SQL form."""
    rows = _features_for(spark, d, spec=NATURAL_SHAPE)
    model = fit_on_shape(rows, NATURAL_SHAPE)
    return _linear_scores(forecast.predict({"shape": model}, rows, NATURAL_SHAPE), "shape", NATURAL_SHAPE)


def series_states(spark, d):
    """Decaying sums along every kept series, in chunks of a few steps."""
    rows = panel(spark, d, STATEFUL).features()
    inputs = ["years_since", "cos_day"]
    states = recurrent.with_states(rows, inputs, STATE_DECAYS, STATEFUL)
    return round_doubles(states.select(*KEYS, "timesteps", *[recurrent.state_name(c, x) for c in inputs for x in STATE_DECAYS]))


def fit_stateful(spark, d):
    """A read-out of inputs and states, fitted on train and run over whole series."""
    rows = _features_for(spark, d, spec=STATEFUL)
    model = recurrent.fit_stateful(rows, STATEFUL, ["cos_day", "post_intervention"], STATE_DECAYS[:1])
    return _linear_scores(forecast.predict({"stateful": model}, rows, STATEFUL), "stateful", STATEFUL)


def tune(spark, d):
    """The library's number of random candidates of both families over all look-backs; no SQL form."""
    rows = _features_for(spark, d, tuning.LOOKBACKS, TUNED)
    found = tuning.search(rows, TUNED, parallel_trials=4)
    return runs.leaderboard(found).select("model_type", "trial_number", "best_val_loss", "best_epoch", "state", "rank")


def _linear_leaderboard(found, *shown):
    return round_doubles(runs.leaderboard(found).select(
        "trial_number", F.col("hyperparameters")["lookback"].cast("bigint").alias("lookback"), *shown,
        "best_val_loss", "best_epoch", "state", "rank"))


def tune_linear(spark, d):
    """Every look-back with the linear family without a penalty; those that no series reaches score infinity."""
    rows = _features_for(spark, d, tuning.LOOKBACKS)
    chosen = [tuning.Candidate(k, "linear", n, {}) for k, n in enumerate(tuning.LOOKBACKS)]
    return _linear_leaderboard(tuning.search(rows, PREVALENCE, ("linear",), chosen={"linear": chosen}))


def tune_ridge(spark, d):
    """Eight squared penalties at each look-back: 32 candidates from one pass over training and four over validation."""
    rows = _features_for(spark, d, tuning.LOOKBACKS, TUNED)
    chosen = [tuning.Candidate(k, "linear", n, {"regParam": p})
              for k, (n, p) in enumerate((n, p) for n in tuning.LOOKBACKS for p in RIDGE)]
    found = tuning.search(rows, TUNED, ("linear",), chosen={"linear": chosen})
    return _linear_leaderboard(found).drop("rank")


def tune_fit_compare(spark, d):
    """Search, refit of the winners, and their records on the test split; boosting has no SQL form."""
    found, scores, _ = pipeline.tune_fit_compare(panel(spark, d, TUNED), trials=8, parallel_trials=4)
    best = runs.best_trial(found).select(F.col("model_type").alias("model"), "best_val_loss", "best_epoch")
    return scores.join(best, "model")


def training_history(spark, d):
    """Rounds of both families as epochs, reported like any other run; boosting has no SQL form."""
    rows = _features_for(spark, d)
    models = pipeline.fit_models(rows, PREVALENCE, {"linear": {}, "boosted": {"seed": PREVALENCE.seed}})
    batched = sequences.batched_steps(rows, PREVALENCE, tuning.numbered(PREVALENCE.lookback))
    parts = [forecast.history(model, family, batched, PREVALENCE) for family, model in models.items()]
    return runs.patience_counter(parts[0].unionByName(parts[1]), ["model", "trial"])


def early_stop(spark, d):
    """Boosting that ends by patience and keeps its best round, with every step's forecast; no SQL form."""
    rows = _features_for(spark, d)
    trained = forecast.fit_early(rows, PREVALENCE, tuning.numbered(PREVALENCE.lookback), patience=2, seed=PREVALENCE.seed)
    scored = forecast.predict({"boosted": trained.model}, rows, PREVALENCE)
    return forecast.natural_predictions(scored, ["boosted"], PREVALENCE).withColumns(
        {"stop_epoch": F.lit(trained.stop_epoch), "best_epoch": F.lit(trained.best_epoch)})


# sinks: written twice below the staging folder, first with other content, then read back

def saved_path(spark, name):
    folder = staging_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def saved_split(spark, d):
    path, table = saved_path(spark, "split"), split.split_table(labelled(spark, d), PREVALENCE)
    records.write_split(table.withColumn("split", F.lit("train")), path, PREVALENCE)
    records.write_split(table, path, PREVALENCE)
    return records.read_split(spark, path, PREVALENCE)


def reused_split(spark, d):
    """A panel labelled anew by the split that an earlier run saved, of which the test part was lost."""
    path, series = saved_path(spark, "split"), kept(spark, d)
    first = pipeline.label_outline(series, PREVALENCE, path)
    records.write_split(split.split_table(first, PREVALENCE).filter("split <> 'test'"), path, PREVALENCE)
    again = pipeline.label_outline(series, PREVALENCE, path, reuse_split=True)
    return split.split_table(again, PREVALENCE)


def split_examples(spark, d):
    table = split.split_table(labelled(spark, d), PREVALENCE)
    doctored = table.unionByName(table.filter("split = 'test'").withColumn("split", F.lit("train")))
    return split.overlap_examples(doctored, PREVALENCE)


def saved_scaler(spark, d):
    path, scaler = saved_path(spark, "scaler"), scale.fit_scaler(labelled(spark, d), PREVALENCE)
    records.write_scaler(scaler.select(*[F.lit(0.0).alias(c) for c in scaler.columns]), path)
    records.write_scaler(scaler, path)
    return round_doubles(records.read_scaler(spark, path, PREVALENCE))


def saved_metrics(spark, d):
    """Both modes' records in one folder; those of the first are written again."""
    path = saved_path(spark, "metrics")
    for spec, factor in ((PREVALENCE, 2.0), (CASES, 1.0), (PREVALENCE, 1.0)):
        rows = _scored(spark, d, spec).filter("split = 'test'")
        found = metrics.metrics_record(rows, baselines.BASELINES, ["model"], spec)
        records.write_metrics(found.withColumn("mse", F.col("mse") * factor), path, spec)
    return round_doubles(records.read_metrics(spark, path))


def saved_history(spark, d):
    """Histories of two models in one folder; that of the first is written again after the second's."""
    path, history = saved_path(spark, "history"), run_history(spark, d).select(
        F.when(F.col("run") % 2 == 0, "even").otherwise("odd").alias("model"), F.col("run").alias("trial"), "epoch",
        (F.col("val_loss") * 2).alias("train_loss"), "val_loss")
    for part in (history.filter("model = 'even'").limit(1), history.filter("model = 'odd'"), history.filter("model = 'even'")):
        records.write_history(part, path)
    return records.read_history(spark, path)


def trial_records(spark, d):
    """The trials as their saved form; the number of events stands for the look-back and the best epoch."""
    n = F.col("n_events")
    return trials(spark, d).select(
        "trial_number", "model_type",
        F.create_map(F.lit("lookback"), n.cast("double"), F.lit("learning_rate"),
                     rounded(F.col("best_val_loss") / 1000.0, 9)).alias("hyperparameters"),
        "best_val_loss", n.alias("best_epoch"), F.lit("COMPLETE").alias("state"))


def saved_trials(spark, d):
    """All models' trials, then those of one model again."""
    path, found = saved_path(spark, "trials"), trial_records(spark, d)
    records.write_trials(found.withColumn("best_val_loss", F.when(
        F.col("model_type") == "view", -1.0).otherwise(F.col("best_val_loss"))), path)
    records.write_trials(found.filter("model_type = 'view'"), path)
    back = records.read_trials(spark, path)
    return back.select("model_type", "trial_number", "best_val_loss", "best_epoch", "state",
                       F.col("hyperparameters")["lookback"].alias("lookback"))


def best_params(spark, d):
    """Saved best parameters of two models, the combined table lacking the others, over defaults for all."""
    combined, own = saved_path(spark, "best"), {m: saved_path(spark, m) for m in ("click", "view")}
    best = runs.best_trial(trial_records(spark, d))
    records.write_best_params(best.filter("model_type = 'click'"), combined)
    for model, path in own.items():
        records.write_best_params(best.filter(F.col("model_type") != model).limit(1).withColumn("model_type", F.lit(model)), path)
        records.write_best_params(best.filter(F.col("model_type") == model), path)
    models = ["click", "purchase", "signup", "view"]
    loaded = records.read_best_params(spark, models, combined, own).filter("hyperparameters IS NOT NULL").select(
        "model_type", F.col("hyperparameters")["learning_rate"].alias("learning_rate"),
        F.col("hyperparameters")["lookback"].cast("bigint").alias("lookback"))
    defaults = trials(spark, d).select("model_type").distinct().select(
        "model_type", F.lit(DEFAULT_PARAMETERS["learning_rate"]).alias("learning_rate"),
        F.lit(DEFAULT_PARAMETERS["lookback"]).cast("bigint").alias("lookback"))
    return runs.choose_parameters(defaults, loaded, loaded.limit(0), ["learning_rate", "lookback"])


def ordered_panel(spark, d):
    """The panel saved in order of its keys, and a range of parameters read from the files that hold it."""
    path = saved_path(spark, "ordered")
    table = panel(spark, d).features().select(*KEYS, "timesteps", "abs_timesteps", "split", "y")
    ordered.write_ordered(table.limit(5), path, [*KEYS, "timesteps"])
    ordered.write_ordered(table, path, [*KEYS, "timesteps"])
    return round_doubles(ordered.read_range(spark, path, table.schema, "parameter_index", *ORDERED_RANGE))


def saved_report(spark, d):
    path, table = saved_path(spark, "report"), actual_vs_pred(spark, d)
    records.write_actual_vs_predicted(table.limit(3), path)
    records.write_actual_vs_predicted(table, path)
    return records.read_actual_vs_predicted(spark, baselines.BASELINES, path, PREVALENCE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_panel, param_limit, distinct_units, sample_units, semi_join_sample, row_rate,
        window_prevalence, window_rate, renumber, renumber_by_series, threshold_filter, series_outline,
        split_params, split_series, split_sizes, split_overlap, split_restrict, scaler_stats,
        gate_scale, event_features, cyclic_time, norm_time, target_logit, target_log1p, target_roundtrip,
        row_weights, panel_features, panel_features_rate,
        window_starts, window_rows, batch_ids, train_batches, coverage,
        diffs, weighted_loss, shape_loss, batch_loss, metrics_prevalence, metrics_rate, compare_models,
        best_epoch, patience, run_report, leaderboard, best_trial, param_precedence,
        report_params, report_series, actual_vs_pred, report_table,
        fit_score, fit_score_linear, fit_shape, fit_shape_natural, series_states, fit_stateful, training_history, early_stop,
        tune, tune_linear, tune_ridge, tune_fit_compare,
        saved_split, reused_split, split_examples, saved_scaler, saved_metrics, saved_history, saved_trials, best_params,
        saved_report, ordered_panel,
    )
}
