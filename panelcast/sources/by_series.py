"""Facts and window rows kept by series: tables bucketed by (parameter, simulation, chunk).

A chunk is the span of days whose windows are numbered together, so window sums, numbering within chunks and joins with the
outline all work inside one bucket: from the scan to gap-free steps nothing is shuffled. A long series has many chunks and is
spread over the buckets. The column that names the chunk carries the settings it was made with in its metadata; rows without
them, or with those of another spec, are treated like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.stage import Layout
from panelcast.spec import PanelSpec

CHUNK = "chunk"
_SETTINGS = "panelcast"


def _settings(spec: PanelSpec) -> dict[str, int]:
    return {"burn_in": spec.burn_in, "window": spec.window, "windows": spec.chunk}


def layout_of(rows: DataFrame, spec: PanelSpec) -> Layout | None:
    """How rows kept by series under the settings of ``spec`` are bucketed; None for all other rows."""
    if CHUNK not in rows.columns:
        return None
    made = dict(rows.schema[CHUNK].metadata.get(_SETTINGS, {}))
    buckets = made.pop("buckets", None)
    return Layout(buckets, (*spec.pair, CHUNK)) if buckets and made == _settings(spec) else None


def with_chunks(facts: DataFrame, spec: PanelSpec, buckets: int) -> DataFrame:
    """Facts with the chunk of each day; days of the burn-in lie in chunks below zero, rows without a day in none."""
    if CHUNK in facts.columns:
        raise ValueError(f"the facts already have a column {CHUNK!r}")
    span = spec.window * spec.chunk
    chunk = F.floor((F.col(spec.day) - spec.burn_in) / span).cast("bigint")
    return facts.select("*", chunk.alias(CHUNK, metadata={_SETTINGS: {**_settings(spec), "buckets": buckets}}))


def write_by_series(facts: DataFrame, table: str, spec: PanelSpec, buckets: int, path: str | None = None) -> None:
    """Save facts as a catalog table by series, at ``path`` if given; one shuffle, one sorted file per bucket.

    A table of that name is never replaced: a new state of the facts takes a new name and path. ``read_fact_table`` reads it.
    """
    placed = with_chunks(facts, spec, buckets)
    layout_of(placed, spec).save(placed, table, path)
