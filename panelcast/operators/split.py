"""Train, validate and test by parameter set, so that no parameter is in two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.outline import one_per_series
from panelcast.operators.sampling import seeded_order
from panelcast.spec import SPLITS, TRAIN_SHARE, VALIDATE_SHARE, PanelSpec


def distinct_params(series: DataFrame, spec: PanelSpec) -> DataFrame:
    return series.select(spec.param).distinct()


def split_params(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Label each parameter by its rank in a seeded shuffle: 70 %, 15 %, and the rest.

    The order is a digest in hex, so its leading digits cut it into 4,096 even buckets: what lies before a
    bucket comes from the buckets' counts, and a parameter is ranked within its bucket.
    """
    shuffled = distinct_params(series, spec).withColumn(
        "_order", seeded_order(spec, spec.param, salt="split")
    ).withColumn("_bucket", F.substring("_order", 1, 3))
    counts = shuffled.groupBy("_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_count"),
    )
    in_bucket = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", spec.param))
    # at most 4,096 rows
    ranked = shuffled.join(F.broadcast(counts), "_bucket").withColumn("_rank", F.col("_before") + in_bucket - 1)
    n_train = F.floor(F.lit(TRAIN_SHARE) * F.col("_count"))
    n_validate = F.floor(F.lit(VALIDATE_SHARE) * F.col("_count"))
    label = (
        F.when(F.col("_rank") < n_train, "train")
        .when(F.col("_rank") < n_train + n_validate, "validate")
        .otherwise("test")
    )
    return ranked.select(spec.param, label.alias("split"))


def split_series(series: DataFrame, labels: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every series of a parameter takes the parameter's label."""
    return series.join(labels, spec.param)


def split_table(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """The saved form: (parameter, simulation, global id, split)."""
    return one_per_series(series).select(*spec.unit, "split")


def restrict_split(saved: DataFrame, series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Entries of a saved split with a known label whose series exist in this run."""
    known = saved.filter(F.col("split").isin(*SPLITS))
    return known.join(one_per_series(series).select(*spec.pair), spec.pair, "left_semi")


def split_overlap(split: DataFrame, spec: PanelSpec) -> DataFrame:
    """Series found under more than one label, in one aggregate rather than three intersections."""
    return (
        split.groupBy(*spec.pair)
        .agg(F.count_distinct("split").alias("n_splits"))
        .filter(F.col("n_splits") > 1)
    )


def overlap_examples(split: DataFrame, spec: PanelSpec, count: int = 5) -> DataFrame:
    """The first few series, by key, that are in more than one split."""
    return split_overlap(split, spec).select(*spec.pair).orderBy(*spec.pair).limit(count)


def verify_split(split: DataFrame, spec: PanelSpec) -> None:
    """Raise if any series is in two splits; the message shows up to five of them."""
    examples = [(r[0], r[1]) for r in overlap_examples(split, spec).collect()]
    if examples:
        raise ValueError(f"{split_overlap(split, spec).count()} series are in more than one split, such as {examples}")


def split_sizes(split: DataFrame, spec: PanelSpec) -> DataFrame:
    return split.groupBy("split").agg(
        F.count("*").alias("n_series"), F.count_distinct(spec.param).alias("n_params")
    )
