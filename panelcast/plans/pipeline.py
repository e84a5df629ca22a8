"""The whole path from facts to features, scores and comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import (
    baselines, forecast, metrics, outline, report, scale, sequences, split, tuning, windows,
)
from panelcast.operators.features import panel_features
from panelcast.operators.runs import best_trial
from panelcast.sources import records
from panelcast.sources.by_series import layout_of
from panelcast.sources.stage import stage, staged_result
from panelcast.spec import PanelSpec


@dataclass(frozen=True)
class Panel:
    """Staged window rows, the outline of the kept series with split labels, and the scaler."""

    spec: PanelSpec
    windows: DataFrame
    outline: DataFrame
    scaler: DataFrame

    def features(self, carry: tuple[str, ...] = ()) -> DataFrame:
        return panel_features(self.windows, self.outline, self.scaler, self.spec, carry)

    def with_batches(self) -> "Panel":
        """The same panel whose outline also knows where each series' evaluation windows begin."""
        numbered = sequences.number_windows(
            self.outline, self.spec, sequences.evaluation_windows(self.spec)
        )
        return replace(self, outline=numbered)


def kept_outline(rows: DataFrame, spec: PanelSpec, statics: DataFrame | None = None) -> DataFrame:
    """Staged outline of the series that reach the threshold."""
    series = outline.above_threshold(outline.chunk_outline(rows, spec, statics), spec)
    return stage(series, "outline", layout_of(series, spec))


def label_outline(kept: DataFrame, spec: PanelSpec, saved_split: str | None = None,
                  reuse_split: bool = False) -> DataFrame:
    """Add the split: the saved one if ``reuse_split`` asks for it and it is there, else a new one.

    A new split is saved over what ``saved_split`` held. A folder whose writing never ended is not reused.
    """
    spark = kept.sparkSession
    if reuse_split and saved_split is not None and records.is_complete(spark, saved_split):
        saved = split.restrict_split(records.read_split(spark, saved_split, spec), kept, spec)
        split.verify_split(saved, spec)
        return kept.join(saved.select(*spec.pair, "split").distinct(), spec.pair)
    labelled = split.split_series(kept, split.split_params(kept, spec), spec)
    if saved_split is not None:
        records.write_split(split.split_table(labelled, spec), saved_split, spec)
    return labelled


def prepare(facts: DataFrame, spec: PanelSpec, statics: DataFrame | None = None, saved_split: str | None = None,
            population: DataFrame | None = None, reuse_split: bool = False) -> Panel:
    """Sample, aggregate, threshold, split and fit the scaler. Window rows and the labelled outline are staged.

    With facts kept by series both are staged in the same buckets, and meet there.
    """
    rows = windows.stage_windows(facts, spec, population)
    labelled = staged_result(
        facts.sparkSession, "series",
        lambda: label_outline(kept_outline(rows, spec, statics), spec, saved_split, reuse_split), layout_of(rows, spec))
    return Panel(spec, rows, labelled, scale.fit_scaler(labelled, spec))


def baseline_rows(panel: Panel, shown: Panel | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Steps with both baselines' forecasts: of the whole panel, or of the part ``shown``.

    Seasons are always learned from the whole panel.
    """
    inputs = panel.spec.feature_columns
    every = panel.features().drop(*inputs)
    rows = (shown or panel).features(("previous_y", "y_before", *carry)).drop(*inputs)
    return baselines.predict_baselines(rows, panel.spec, every)


def shown_series(panel: Panel) -> DataFrame:
    """One series of each of up to nine test parameters."""
    spec = panel.spec
    return report.report_series(
        panel.windows, report.test_series(panel.outline, spec), report.report_params(panel.outline, spec), spec
    )


def report_table(panel: Panel, forecasts: Callable[[Panel], DataFrame], models: list[str]) -> DataFrame:
    """Actual against predicted for the shown series; only their rows are ever joined or forecast."""
    spec = panel.spec
    # one row per shown parameter, so at most nine
    chosen = F.broadcast(shown_series(panel).select(*spec.pair))
    part = replace(
        panel,
        windows=panel.windows.join(chosen, spec.pair, "left_semi"),
        outline=panel.outline.join(chosen, spec.pair, "left_semi"),
    )
    return report.actual_vs_predicted(forecasts(part), models, spec)


def evaluation_rows(panel: Panel) -> DataFrame:
    """Baseline forecasts over complete non-overlapping windows, with batch numbers."""
    rows = baseline_rows(panel, panel.with_batches(), ("windows_before",))
    return sequences.batched_steps(rows, panel.spec)


def features_with_windows(panel: Panel, lookbacks: tuple[int, ...]) -> DataFrame:
    """Features that also know, for each look-back, where their series' evaluation windows begin."""
    numbered = panel.outline
    for lookback in dict.fromkeys(lookbacks):
        own = panel.spec.with_(lookback=lookback)
        numbered = sequences.number_windows(
            numbered, own, sequences.evaluation_windows(own), tuning.numbered(lookback)
        )
    return replace(panel, outline=numbered).features(tuple(tuning.numbered(n) for n in dict.fromkeys(lookbacks)))


def fit_models(features: DataFrame, spec: PanelSpec, parameters: dict[str, dict[str, float]]) -> dict[str, Model]:
    """Fit each family with its parameters on the staged feature table.

    A ``lookback`` among the parameters replaces the panel's, as it decides the training windows.
    """
    models = {}
    for family, chosen in parameters.items():
        own = spec.with_(lookback=int(chosen.get("lookback", spec.lookback)))
        models[family] = forecast.fit(family, features, own, **{k: v for k, v in chosen.items() if k != "lookback"})
    return models


def winning_parameters(parameters: dict[str, float], best_epoch: int) -> dict[str, float]:
    """The parameters that give the model of the best round: rounds are grown one after another, so the first ones are equal."""
    return {**parameters, "maxIter": best_epoch} if "maxIter" in parameters else parameters


def tune_fit_compare(panel: Panel, trials: int, parallel_trials: int = 1, timeout: float | None = None,
                     lookbacks: tuple[int, ...] = tuning.LOOKBACKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search, refit the best candidate of each family, score the test split and compare.

    A boosted winner is refitted with as many rounds as its best one had: that is the model the search ranked. Returns
    the trial table, the metrics record per model, and the actual-vs-predicted table. A family whose trials all
    failed is fitted with its defaults.
    """
    spec = panel.spec
    features = stage(features_with_windows(panel, (*lookbacks, spec.lookback)), "features")
    found = tuning.search(features, spec, trials=trials, parallel_trials=parallel_trials, timeout=timeout,
                          lookbacks=lookbacks)
    chosen = {family: {} for family in forecast.FAMILIES}
    for row in best_trial(found).filter(F.col("state") == "COMPLETE").collect():
        chosen[row.model_type] = winning_parameters(row.hyperparameters, row.best_epoch)
    scored = stage(forecast.predict(fit_models(features, spec, chosen), features, spec), "scored")

    records_ = None
    for family, parameters in chosen.items():
        own = spec.with_(lookback=int(parameters.get("lookback", spec.lookback)))
        rows = sequences.batched_steps(scored.filter("split = 'test'"), own, tuning.numbered(own.lookback))
        part = metrics.metrics_record(rows, [family], ["model"], own)
        records_ = part if records_ is None else records_.unionByName(part)
    table = report.actual_vs_predicted(scored, list(chosen), spec)
    return found, records_, table
