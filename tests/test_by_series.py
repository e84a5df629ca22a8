"""Facts kept by series: the same results without a shuffle from the scan to gap-free steps."""

import uuid

import pytest
import small
from pyspark.sql import functions as F

from panelcast.operators import outline, sampling, windows
from panelcast.plans import pipeline
from panelcast.sources import by_series
from panelcast.sources.facts import read_fact_table, select_facts
from panelcast.sources.stage import staging_scope

SPEC = small.SPEC
BUCKETS = 6


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    name = f"facts_{uuid.uuid4().hex}"
    facts = spark.createDataFrame(small.facts()).repartition(5)
    by_series.write_by_series(facts, name, SPEC, BUCKETS, str(tmp_path_factory.mktemp("by_series") / "facts"))
    yield name
    spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def no_broadcasts(spark):
    """As for big tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plain(spark):
    return select_facts(spark.createDataFrame(small.facts()), SPEC)


def physical(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def shown(df):
    """All columns, doubles without the last digits, which hang on the order of sums."""
    return [F.round(c, 9) if t == "double" else c for c, t in df.dtypes]


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


WINDOW = ("parameter_index", "simulation_index", "global_index", "group_id", "prevalence", "abs_timesteps", "a", "b", "c",
          "chunk", "in_chunk", "valid_in_chunk", "previous_y")


def test_numbered_windows_need_no_shuffle(spark, table, no_broadcasts):
    got = windows.number_in_chunks(windows.panel_windows(read_fact_table(spark, table, SPEC), SPEC), SPEC)
    want = windows.number_in_chunks(windows.panel_windows(plain(spark), SPEC), SPEC)
    assert "Exchange" not in physical(got) and "Exchange" in physical(want)
    assert "SelectedBucketsCount: 6 out of 6" in physical(got)
    assert by_series.layout_of(got, SPEC).buckets == BUCKETS
    assert "Exchange" not in physical(by_series.layout_of(got, SPEC).place(got))  # nor is one needed to keep them so
    assert rows_of(got, *WINDOW) == rows_of(want, *WINDOW)


def test_samples_reach_their_buckets_without_moving_facts(spark, table, no_broadcasts):
    spec = SPEC.with_(sims_per_param=2, param_limit=102)
    got = sampling.sampled(read_fact_table(spark, table, spec), spec)
    want = sampling.sampled(plain(spark), spec)
    assert "Exchange" not in physical(got)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert "Exchange" not in physical(windows.window_sums(got, spec))


@pytest.mark.parametrize("sims", [None, 2])
def test_steps_need_no_shuffle(spark, table, no_broadcasts, sims):
    spec = SPEC.with_(sims_per_param=sims)
    with staging_scope():
        got = pipeline.prepare(read_fact_table(spark, table, spec), spec)
        want = pipeline.prepare(plain(spark), spec)
        steps, plain_steps = (windows.with_steps(p.windows, p.outline, spec) for p in (got, want))
        assert "Exchange" not in physical(steps) and "Exchange" in physical(plain_steps)
        assert "Exchange" not in physical(got.windows.join(got.outline, [*spec.pair, "chunk"]))
        assert rows_of(steps, *WINDOW, "timesteps") == rows_of(plain_steps, *WINDOW, "timesteps")
        assert rows_of(got.features(), *shown(want.features())) == rows_of(want.features(), *shown(want.features()))
        staged = [p.staged_table for p in (got.windows, got.outline)]
        assert all(map(spark.catalog.tableExists, staged))
    assert not any(map(spark.catalog.tableExists, staged))


def test_only_the_outline_moves_when_it_is_made(spark, table, no_broadcasts):
    with staging_scope():
        rows = windows.stage_windows(read_fact_table(spark, table, SPEC), SPEC)
        text = physical(outline.chunk_outline(rows, SPEC))
        assert text.count("Exchange") == 1 and text.index("Window") < text.index("Exchange")  # one row per chunk


def test_another_spec_takes_the_usual_way(spark, table):
    for spec in (SPEC.with_(window=7), SPEC.with_(chunk=4), SPEC.with_(burn_in=3)):
        facts = read_fact_table(spark, table, spec)
        assert "chunk" not in facts.columns
        got = windows.number_in_chunks(windows.panel_windows(facts, spec), spec)
        want = windows.number_in_chunks(windows.panel_windows(plain(spark), spec), spec)
        assert rows_of(got, *WINDOW) == rows_of(want, *WINDOW)


def test_a_foreign_column_of_that_name_is_not_taken_for_it(spark):
    facts = spark.createDataFrame(small.facts()).withColumn("chunk", F.rand(1))
    assert by_series.layout_of(facts, SPEC) is None
    got, want = (windows.number_in_chunks(windows.panel_windows(f, SPEC), SPEC) for f in (facts, plain(spark)))
    assert rows_of(got, *WINDOW) == rows_of(want, *WINDOW)
    with pytest.raises(ValueError):
        by_series.with_chunks(facts, SPEC, BUCKETS)


def test_a_long_series_is_spread_and_missing_keys_are_kept(spark, tmp_path):
    name = f"facts_{uuid.uuid4().hex}"
    days = [(1, 0, 10, d, 1.0, 2.0) for d in range(3_000)] + [(p, 0, p * 10, 12, 1.0, 2.0) for p in range(2, 50)]
    odd = [(None, 0, 5, 20, 1.0, 2.0), (1, None, 6, 20, 1.0, 2.0), (1, 0, 10, None, 1.0, 2.0)]
    facts = spark.createDataFrame(
        days + odd, "parameter_index int, simulation_index int, global_index int, timesteps int, hits double, tests double")
    by_series.write_by_series(facts, name, SPEC, BUCKETS, str(tmp_path / "facts"))
    kept = spark.table(name)
    assert kept.count() == len(days + odd)
    files = [r["count"] for r in kept.groupBy(F.input_file_name()).count().collect()]
    assert len(files) == BUCKETS and max(files) < 0.4 * len(days)
    columns = ("parameter_index", "simulation_index", "group_id", "prevalence", "chunk", "in_chunk")
    got, want = (windows.number_in_chunks(windows.panel_windows(f, SPEC), SPEC)
                 for f in (read_fact_table(spark, name, SPEC), select_facts(facts, SPEC)))
    assert rows_of(got, *columns) == rows_of(want, *columns)
    spark.sql(f"DROP TABLE {name}")


def test_no_facts(spark, tmp_path):
    name = f"facts_{uuid.uuid4().hex}"
    facts = spark.createDataFrame(small.facts()).limit(0)
    by_series.write_by_series(facts, name, SPEC, BUCKETS, str(tmp_path / "facts"))
    rows = windows.panel_windows(read_fact_table(spark, name, SPEC), SPEC)
    assert rows.count() == 0
    spark.sql(f"DROP TABLE {name}")
