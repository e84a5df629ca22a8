"""Positions in a total order over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.stage import stage


def running_total(df: DataFrame, order: list[str], weight: Column, before: str,
                  total: str | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows, and optionally over all rows.

    Rows are range-partitioned by ``order`` (which must be unique), so each partition is one slice
    of the order. Slices are summed, the running sum over slices is taken on one row per slice, and
    each slice finishes its own rows. The slice table has at most one row per shuffle partition.
    """
    placed = _sliced(df, order, weight)
    slices = placed.groupBy("_slice").agg(F.sum("_weight").alias("_size"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_slice",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_slice_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    out = _finished(placed.join(F.broadcast(slices), "_slice"), ["_slice"], order, before)
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_slice", "_weight", "_slice_before", "_total")


def total_within(df: DataFrame, group: str, order: list[str], weight: Column, before: str,
                 total: str | None = None) -> DataFrame:
    """The same running total, started anew in each group; a group of any size spans many slices.

    The table of sums has a row per slice and group that meet: slices and groups together at most.
    """
    placed = _sliced(df, [group, *order], weight)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy("_slice", group).agg(F.sum("_weight").alias("_size")).select(
        "_slice", group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_slice_before"),
        F.sum("_size").over(Window.partitionBy(group)).alias("_total"),
    )
    out = _finished(placed.join(slices, ["_slice", group]), ["_slice", group], order, before)
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_slice", "_weight", "_slice_before", "_total")


def _sliced(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """Rows with the number of their range partition, written once so that it cannot change."""
    return stage(
        df.withColumn("_weight", weight.cast("bigint"))
        .repartitionByRange(*order)
        .withColumn("_slice", F.spark_partition_id()),
        "ordered",
    )


def _finished(rows: DataFrame, within: list[str], order: list[str], before: str) -> DataFrame:
    earlier = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(before, F.col("_slice_before") + F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
