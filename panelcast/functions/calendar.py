"""Time and event features, as column expressions over an absolute day number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.spec import DAYS_PER_YEAR, PanelSpec


def is_after(day: Column, spec: PanelSpec) -> Column:
    return day >= spec.intervention


def post_intervention(day: Column, spec: PanelSpec) -> Column:
    return is_after(day, spec).cast("int")


def years_since(day: Column, spec: PanelSpec) -> Column:
    return F.greatest(F.lit(0), day - spec.intervention) / float(DAYS_PER_YEAR)


def day_angle(day: Column) -> Column:
    return 2 * F.pi() * (day % DAYS_PER_YEAR) / float(DAYS_PER_YEAR)


def time_norm(step: Column, first: Column, last: Column) -> Column:
    """Position between first and last step; a single-step series keeps its raw step."""
    return F.when(last > first, (step - first) / F.nullif(last - first, F.lit(0))).otherwise(
        step.cast("double")
    )
