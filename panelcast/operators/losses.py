"""Weighted level, slope and curvature losses over scored steps.

Input rows are steps: the series key, ``start``, ``position``, ``y``, ``w``, and for every model its forecast in
a column ``yhat_<model>``, in transformed space. Steps are told apart by model only after the differences,
so the sort that these need does not grow with the number of models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import targets
from panelcast.spec import PanelSpec


def weighted_mse(error: Column, weight: Column) -> Column:
    """Sum of weighted squares over the total weight, the latter at least 1."""
    return F.sum(weight * error * error) / F.greatest(F.sum(weight), F.lit(1.0))


def in_space(column: str, spec: PanelSpec, space: str | None = None) -> Column:
    natural = (space or spec.loss_space) == "natural"
    return targets.inverse(F.col(column), spec) if natural else F.col(column)


def forecast_of(model: str) -> str:
    return f"yhat_{model}"


def by_model(rows: DataFrame, models: list[str], parts: tuple[str, ...] = ("yhat",)) -> DataFrame:
    """A row per step and model, with ``model`` and the model's own columns ``<part>_<model>`` as ``<part>``."""
    own = {f"{part}_{m}" for part in parts for m in models}
    each = [F.struct(F.lit(m).alias("model"), *[F.col(f"{part}_{m}").alias(part) for part in parts]) for m in models]
    return rows.select(*[c for c in rows.columns if c not in own], F.inline(F.array(*each)))


def differenced(rows: DataFrame, models: list[str], spec: PanelSpec, space: str | None = None) -> DataFrame:
    """Steps with levels, first and second differences of truth (``t0`` to ``t2``) and of each model's forecast.

    Mid-point weights are ``w0`` to ``w2``. Differences stay inside one look-back window, so each sort group has L rows.
    """
    step = Window.partitionBy(*spec.pair, "start").orderBy("position")
    level = rows.withColumns({
        "t0": in_space("y", spec, space), "w0": F.col("w"),
        **{f"p0_{m}": in_space(forecast_of(m), spec, space) for m in models},
    })
    for order in (1, 2):
        def lagged(name: str):
            return F.lag(name).over(step)

        parts = {f"p{order}_{m}": f"p{order - 1}_{m}" for m in models} | {f"t{order}": f"t{order - 1}"}
        weight = f"w{order - 1}"
        level = level.select(
            "*",
            *[(F.col(last) - lagged(last)).alias(name) for name, last in parts.items()],
            ((F.col(weight) + lagged(weight)) * 0.5).alias(f"w{order}"),
        )
    return level


def with_differences(rows: DataFrame, models: list[str], spec: PanelSpec, space: str | None = None) -> DataFrame:
    """First and second differences of truth and forecasts, with mid-point weights; a row per step and model."""
    return by_model(differenced(rows, models, spec, space), models, ("yhat", "p0", "p1", "p2"))


def shape_terms(spec: PanelSpec, model: str | None = None) -> dict[str, Column]:
    """Aggregates over rows with differences. A group without differences has zero for that term.

    ``model`` takes the model's own columns of ``differenced``.
    """
    own = "" if model is None else f"_{model}"

    def term(order: int) -> Column:
        return weighted_mse(F.col(f"p{order}{own}") - F.col(f"t{order}"), F.col(f"w{order}" if order else "w"))

    return {
        "base_loss": term(0),
        "slope_loss": F.coalesce(term(1), F.lit(0.0)),
        "curvature_loss": F.coalesce(term(2), F.lit(0.0)) if spec.curvature_weight else F.lit(0.0),
    }


def with_total(losses: DataFrame, spec: PanelSpec) -> DataFrame:
    shape = spec.slope_weight * F.col("slope_loss") + spec.curvature_weight * F.col("curvature_loss")
    return losses.withColumn("total_loss", F.col("base_loss") + shape)


def shape_loss(rows: DataFrame, models: list[str], by: list[str], spec: PanelSpec,
               space: str | None = None) -> DataFrame:
    """Level, slope and curvature loss per group, and their weighted total."""
    terms = with_differences(rows, models, spec, space).groupBy(*by)
    return with_total(terms.agg(*[c.alias(name) for name, c in shape_terms(spec).items()]), spec)


def level_loss(rows: DataFrame, models: list[str], by: list[str], spec: PanelSpec, space: str) -> DataFrame:
    """The level term alone, without the sort that differences need."""
    error = in_space("yhat", spec, space) - in_space("y", spec, space)
    return by_model(rows, models).groupBy(*by).agg(weighted_mse(error, F.col("w")).alias("base_loss"))


def mean_batch_loss(rows: DataFrame, models: list[str], by: list[str], spec: PanelSpec) -> DataFrame:
    """Means over batches of the total loss and of the level loss in transformed space.

    Rows carry ``batch_id``; both means of all models come from one pass over them. Models stand side by side until
    their batches are summed, so no step is ever copied.
    """
    groups = [c for c in by if c != "model"]
    sums, terms = [], ("base_loss", "slope_loss", "curvature_loss", "level_loss")
    for m in models:
        own = shape_terms(spec, m) | {"level_loss": weighted_mse(F.col(forecast_of(m)) - F.col("y"), F.col("w"))}
        sums += [own[term].alias(f"{term}_{m}") for term in terms]
    batches = by_model(differenced(rows, models, spec).groupBy(*groups, "batch_id").agg(*sums), models, terms)
    return with_total(batches, spec).groupBy(*by).agg(
        F.count("*").alias("n_batches"),
        F.avg("total_loss").alias("mean_batch_loss"),
        F.avg("level_loss").alias("avg_loss_transformed"),
    )
