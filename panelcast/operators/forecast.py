"""Weighted forecasters fitted with Spark ML on transformed targets."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.operators import losses
from panelcast.operators.boosting import FORECAST, BinnedSteps, Training, fit_boosted, fit_rounds
from panelcast.operators.losses import forecast_of
from panelcast.operators.sequences import batched_steps, coverage
from panelcast.spec import PanelSpec

HISTORY_SCHEMA = "model string, trial bigint, epoch bigint, train_loss double, val_loss double"
FAMILIES = {"linear": LinearRegression, "boosted": GBTRegressor}


def create_model(family: str, **params) -> Estimator:
    """An unfitted estimator of the named family, whose forecast goes to ``yhat_<family>``."""
    try:
        kind = FAMILIES[family.lower()]
    except KeyError:
        raise ValueError(f"unknown model family {family!r}; choose from {sorted(FAMILIES)}") from None
    return kind(featuresCol="features", labelCol="y", weightCol="fit_weight",
                predictionCol=forecast_of(family.lower()), **params)


def assemble(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add the feature vector; a plain column expression in the JVM."""
    return VectorAssembler(inputCols=spec.feature_columns, outputCol="features").transform(features)


def weighted_steps(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Training steps, each weighted by its row weight and the training windows that hold it."""
    weighted = features.filter(F.col("split") == "train").withColumn(
        "fit_weight", F.col("w") * coverage(spec)
    )
    return weighted.filter(F.col("fit_weight") > 0)


def training_rows(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """``weighted_steps`` with the feature vector."""
    return assemble(weighted_steps(features, spec), spec).select("features", "y", "fit_weight")


def boosting_steps(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """What boosting reads of ``weighted_steps``."""
    return weighted_steps(features, spec).select(*spec.pair, "position", *spec.feature_columns, "y", "fit_weight")


def fit(family: str, features: DataFrame, spec: PanelSpec, shared: BinnedSteps | None = None, **params) -> Model:
    """Fit on the training split only; boosted trials of one table may share binned steps."""
    estimator = create_model(family, **params)
    boosts = isinstance(estimator, GBTRegressor)
    train = boosting_steps(features, spec) if boosts else training_rows(features, spec)
    if train.isEmpty():
        raise ValueError(f"no training series reaches the look-back length {spec.lookback}")
    return fit_boosted(train, spec, shared, **params) if boosts else estimator.fit(train)


def fit_early(features: DataFrame, spec: PanelSpec, before: str, patience: int | None = None, **params) -> Training:
    """Boosting on the training split that stops ``patience`` rounds (the panel's by default) after its last gain on validation.

    ``before`` names the column with the number of earlier evaluation windows.
    """
    validate = batched_steps(features.filter(F.col("split") == "validate"), spec, before)
    kept = validate.select(*spec.pair, "start", "position", "batch_id", "y", "w", *spec.feature_columns)
    return fit_rounds(boosting_steps(features, spec), kept, spec, spec.patience if patience is None else patience, **params)


def early_history(training: Training, spark: SparkSession, name: str = FORECAST, trial: int = 0) -> DataFrame:
    """The rounds that ran, as a run history without training losses."""
    rows = [(name, trial, k, None, loss) for k, loss in enumerate(training.losses, 1)]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def predict(models: dict[str, Model], features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Score every step of whole series in one pass; each family adds its transformed ``yhat_<family>``."""
    scored = assemble(features, spec)
    for family, model in models.items():
        scored = model.setPredictionCol(forecast_of(family)).transform(scored)
    return scored.drop("features")


def rounds(model: Model, features: DataFrame, spec: PanelSpec) -> tuple[DataFrame, list[str]]:
    """Forecasts after each round of a model, as one more column a round; and the rounds' names.

    A linear model has one round. All rounds of a boosted one come from one pass, each tree scored once.
    """
    names = [str(k) for k in range(1, len(model.trees) + 1)] if hasattr(model, "trees") else ["1"]
    if hasattr(model, "trees"):
        return model.after_rounds(features, [forecast_of(k) for k in names]), names
    return model.setPredictionCol(forecast_of("1")).transform(assemble(features, spec)).drop("features"), names


def history(model: Model, name: str, batched: DataFrame, spec: PanelSpec, trial: int = 0) -> DataFrame:
    """Mean batch loss after each round on train and validate, as a run history: the loss that ranks trials.

    ``batched`` holds the features of scored steps with ``start`` and ``batch_id``.
    """
    scored, names = rounds(model, batched.filter(F.col("split").isin("train", "validate")), spec)
    found = losses.mean_batch_loss(scored, names, ["model", "split"], spec)
    wide = found.groupBy(F.col("model").cast("bigint").alias("epoch")).agg(*[
        F.max(F.when(F.col("split") == s, F.col("mean_batch_loss"))).alias(f"{short}_loss")
        for s, short in (("train", "train"), ("validate", "val"))
    ])
    return wide.select(F.lit(name).alias("model"), F.lit(trial).cast("bigint").alias("trial"), "epoch", "train_loss", "val_loss")


def natural_predictions(rows: DataFrame, models: list[str], spec: PanelSpec) -> DataFrame:
    """Truth and prediction in natural space, one row per (model, series, step)."""
    return losses.by_model(rows, models).select(
        "model",
        *spec.unit,
        "split",
        "timesteps",
        "abs_timesteps",
        targets.inverse(F.col("y"), spec).alias("truth"),
        targets.inverse(F.col("yhat"), spec).alias("prediction"),
    )
