"""Look-back windows of fixed length over each series.

A window is a run of L valid steps starting at ``start``. Training windows overlap (stride), the
others do not. Series shorter than L have none, and evaluation leaves out the last ``T mod L`` steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ordinals import total_within
from panelcast.operators.outline import one_per_series
from panelcast.sources.stage import unsent
from panelcast.spec import PanelSpec


def stride(spec: PanelSpec) -> Column:
    return F.when(F.col("split") == "train", F.lit(spec.train_stride)).otherwise(F.lit(spec.lookback))


def starts_between(first: Column, last: Column, step: Column) -> Column:
    """Multiples of ``step`` in [first, last] as an array, empty if there are none."""
    from_ = F.ceil(first / step).cast("bigint") * step
    return F.when(from_ <= last, F.sequence(from_, last, step)).otherwise(
        F.array().cast("array<bigint>")
    )


def window_starts(outline: DataFrame, spec: PanelSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """Start of every look-back window, made chunk by chunk from series lengths alone.

    ``carry`` names outline columns that the windows keep.
    """
    last = F.least(F.col("valid_before") + F.col("n_valid"), F.col("valid_length") - spec.lookback + 1) - 1
    starts = starts_between(F.col("valid_before"), last, stride(spec).cast("bigint"))
    return outline.select(*spec.pair, "split", *carry, F.explode(starts).alias("start"))


def window_arrays(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every look-back window as arrays ``x`` (L x F), ``y`` and ``w``.

    Steps are packed into runs of bounded size: a run owns P starts and also gets the next L-1
    steps, so each window is a slice of one run and no whole series is ever collected.
    """
    length = spec.lookback
    size = max(spec.chunk, length)
    own = F.floor(F.col("position") / size).cast("bigint")
    tail_of_previous = (F.col("position") % size < length - 1) & (own > 0)
    runs = F.when(tail_of_previous, F.array(own, own - 1)).otherwise(F.array(own))
    step = F.struct("position", F.array(*[F.col(c).cast("double") for c in spec.feature_columns]).alias("x"), "y", "w")
    packed = (
        features.withColumn("run", F.explode(runs))
        .groupBy(*spec.pair, "split", "run")
        .agg(
            F.sort_array(F.collect_list(step)).alias("steps"),
            F.max("valid_length").alias("valid_length"),
        )
    )
    first = F.col("run") * size
    last = F.least(first + size, F.col("valid_length") - length + 1) - 1
    starts = starts_between(first, last, stride(spec).cast("bigint"))
    window = F.slice("steps", (F.col("start") - first + 1).cast("int"), length)
    return (
        packed.withColumn("start", F.explode(starts))
        .withColumn("window", window)
        .select(
            *spec.pair, "split", "start",
            F.col("window.x").alias("x"), F.col("window.y").alias("y"), F.col("window.w").alias("w"),
        )
    )


def scored_steps(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Steps inside non-overlapping complete windows, tagged with their window start; no shuffle."""
    position, length = F.col("position"), spec.lookback
    complete = F.col("valid_length") - F.col("valid_length") % length
    return rows.filter(position < complete).withColumn("start", position - position % length)


def coverage(spec: PanelSpec, order: int = 0) -> Column:
    """How many overlapping training windows hold this step and the ``order`` steps before it.

    Fitting a per-step model on all overlapping windows equals fitting it on single steps weighted
    by this count, without making L copies of the data. The same goes for differences of neighbouring steps.
    """
    first = F.greatest(F.lit(0), F.col("position") - spec.lookback + 1)
    last = F.least(F.col("position") - order, F.col("valid_length") - spec.lookback)
    count = F.floor(last / spec.train_stride) - F.ceil(first / spec.train_stride) + 1
    return F.when(last >= 0, F.greatest(count, F.lit(0))).otherwise(F.lit(0)).cast("double")


def number_windows(outline: DataFrame, spec: PanelSpec, starts_per_series: Column | None = None,
                   name: str = "windows_before") -> DataFrame:
    """Add ``windows_before``, or ``name``: windows of the same split in series with a smaller key.

    Windows are ordered by (parameter, simulation, start). Only series lengths are ranked, so no
    window is made to number it. Both sides of the join grow with the series, so large ones are not sent to every task.
    """
    length = F.col("valid_length")
    if starts_per_series is None:
        starts_per_series = F.greatest(
            F.lit(0), F.floor((length - spec.lookback) / stride(spec)) + 1
        )
    series = one_per_series(outline).select(*spec.pair, "split", starts_per_series.alias("_windows"))
    bases = total_within(series, "split", spec.pair, F.col("_windows"), name)
    return unsent(outline).join(bases.select(*spec.pair, name), spec.pair)


def evaluation_windows(spec: PanelSpec) -> Column:
    """Number of non-overlapping windows of a series, whatever its split."""
    return F.floor(F.col("valid_length") / spec.lookback)


def batch_of(start: Column, step: Column | int, spec: PanelSpec, before: str = "windows_before") -> Column:
    """Batch number of a window: consecutive windows in groups of the batch size."""
    ordinal = F.col(before) + F.floor(start / step)
    return F.floor(ordinal / spec.batch_size).cast("bigint")


def batched_steps(rows: DataFrame, spec: PanelSpec, before: str = "windows_before") -> DataFrame:
    """Steps of complete non-overlapping windows with their window's start and batch number; no shuffle."""
    scored = scored_steps(rows, spec)
    return scored.withColumn("batch_id", batch_of(F.col("start"), spec.lookback, spec, before))
