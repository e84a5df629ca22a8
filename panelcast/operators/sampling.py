"""Which parameter sets and simulations take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.by_series import CHUNK, layout_of
from panelcast.sources.stage import stage
from panelcast.spec import PanelSpec


def seeded_order(spec: PanelSpec, *parts: str | Column, salt: str = "") -> Column:
    """A shuffled order that depends on the seed and the keys only, never on partitioning."""
    prefix = [F.lit(f"{salt}:{spec.seed}" if salt else str(spec.seed))]
    keys = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *prefix, *keys))


def limit_params(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keep parameter indices below the limit, or all."""
    if spec.param_limit is None:
        return df
    return df.filter(F.col(spec.param) < spec.param_limit)


def distinct_units(facts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every (parameter, simulation, global id) present."""
    return limit_params(facts, spec).select(*spec.unit).distinct()


def sample_units(facts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Up to k simulations per parameter in seeded order; (parameter, simulation) pairs.

    Pairs, not (pair, global id) triples, are ranked, so a pair with two ids counts once. The rank
    filter becomes a per-partition top-k before the shuffle: a parameter with very many
    simulations sends k rows per map task.
    """
    pairs = limit_params(facts, spec).select(*spec.pair).distinct()
    if spec.sims_per_param is None:
        return pairs
    order = Window.partitionBy(spec.param).orderBy(
        seeded_order(spec, spec.param, spec.sim), F.col(spec.sim)
    )
    return (
        pairs.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= spec.sims_per_param)
        .drop("_rank")
    )


def keep_units(df: DataFrame, units: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows of the given pairs; a semi-join, so rows never multiply."""
    return df.join(units.select(*spec.pair).distinct(), spec.pair, "left_semi")


def sampled(facts: DataFrame, spec: PanelSpec, population: DataFrame | None = None) -> DataFrame:
    """Facts within the parameter limit, of the sampled series if there is a sample.

    Series are drawn from ``population`` where the facts were already cut, say by date. The staged sample
    has a known size, by which the planner sends it to every scan or shuffles both sides by the pair;
    the latter partitioning also serves the window sums that follow. Facts kept by series stay where they are: their
    sample is brought to one row per chunk, kept in the same buckets.
    """
    facts = limit_params(facts, spec)
    if spec.sims_per_param is None:
        return facts
    layout = layout_of(facts, spec)
    if layout is None:
        units = stage(sample_units(facts if population is None else population, spec), "units")
        return facts.join(units, spec.pair, "left_semi")
    chunks = stage(facts.select(*spec.pair, CHUNK).distinct(), "chunks", layout)
    units = sample_units(chunks if population is None else population, spec)
    chosen = stage(chunks.join(units, spec.pair, "left_semi"), "units", layout)
    return facts.join(chosen, list(layout.keys), "left_semi")
