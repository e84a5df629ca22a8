"""What the physical plans must and must not hold."""

from pathlib import Path

import pytest
import small
from pyspark.sql import functions as F

from panelcast.operators import baselines, losses, metrics, outline, report, sampling, sequences, windows
from panelcast.plans import pipeline
from panelcast.sources.lineitem import LINEITEM_SPEC, lineitem_facts

SPEC = small.SPEC
TABLES = Path("/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def scans(df) -> str:
    """Plan text with whole filter lists."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def fact_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "facts")
    spark.createDataFrame(small.facts()).write.parquet(path)
    return path


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
def test_burn_in_reaches_the_scan(spark):
    text = scans(windows.window_sums(lineitem_facts(spark, str(TABLES), after_burn_in=True), LINEITEM_SPEC))
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_extendedprice" not in text


def test_day_and_parameter_bounds_reach_the_scan(spark, fact_path):
    facts = sampling.limit_params(spark.read.parquet(fact_path), SPEC.with_(param_limit=20))
    text = scans(windows.window_sums(facts, SPEC))
    assert "GreaterThanOrEqual(timesteps,10)" in text and "LessThan(parameter_index,20)" in text
    assert "person_days" not in text.split("ReadSchema")[1]


def test_sample_is_a_per_task_top_k(spark, fact_path):
    text = plan(sampling.sample_units(spark.read.parquet(fact_path), SPEC.with_(sims_per_param=2)))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning(parameter_index", text.index("WindowGroupLimit"))


def test_features_need_no_python_and_no_cross_join(spark, fact_path):
    panel = pipeline.prepare(spark.read.parquet(fact_path), SPEC)
    for df in (panel.features(), metrics.metrics_record(pipeline.evaluation_rows(panel), baselines.BASELINES, ["model"], SPEC)):
        text = plan(df)
        for absent in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate"):
            assert absent not in text.split("== Physical Plan ==")[1], absent


def test_row_level_sorts_are_by_chunk(spark, fact_path):
    rows = windows.number_in_chunks(windows.panel_windows(spark.read.parquet(fact_path), SPEC), SPEC)
    physical = plan(rows).split("== Physical Plan ==")[1]
    sort = next(line for line in physical.splitlines() if "Sort [" in line)
    assert "chunk" in sort
    text = plan(outline.chunk_outline(pipeline.windows.stage(rows, "w"), SPEC)).split("== Physical Plan ==")[1]
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def physical(df) -> str:
    return plan(df).split("== Physical Plan ==")[1]


def test_evaluation_shuffles_steps_once_however_many_models(spark, fact_path):
    rows = pipeline.evaluation_rows(pipeline.prepare(spark.read.parquet(fact_path), SPEC))
    text = physical(losses.shape_loss(rows, baselines.BASELINES, ["model", "split"], SPEC))
    assert text.count("Exchange hashpartitioning(parameter_index") - physical(rows).count(
        "Exchange hashpartitioning(parameter_index") == 1
    assert text.index("Generate") < text.index("Window")  # models part above the differences


def test_comparing_with_the_truth_is_a_projection(spark, fact_path):
    rows = pipeline.baseline_rows(pipeline.prepare(spark.read.parquet(fact_path), SPEC))
    assert physical(report.actual_vs_predicted(rows, baselines.BASELINES, SPEC)).count("Exchange") == physical(rows).count("Exchange")


def test_window_numbers_ride_along_when_starts_are_made(spark, fact_path):
    panel = pipeline.prepare(spark.read.parquet(fact_path), SPEC)
    numbered = sequences.number_windows(panel.outline, SPEC)
    text = physical(sequences.window_starts(numbered, SPEC, ("windows_before",)))
    assert "Join" not in text[:text.index("Generate explode")]


def test_staged_tables_are_not_sent_to_every_task_for_small_files(spark, fact_path, monkeypatch):
    """Staged series and windows are small files even where they are millions of rows."""
    panel = pipeline.prepare(spark.read.parquet(fact_path), SPEC)

    def numbered():
        once = sequences.number_windows(panel.outline, SPEC, sequences.evaluation_windows(SPEC), "n")
        return sequences.number_windows(once, SPEC.with_(lookback=3))

    small, few = numbered(), panel.features()
    assert "BroadcastHashJoin [parameter_index" in physical(small)  # a few rows may be sent
    monkeypatch.setattr("panelcast.sources.stage.SENT_BYTES", 0)
    many, rows = numbered(), panel.features()
    for df, joins in ((many, 2), (rows, 1)):
        assert physical(df).count("SortMergeJoin [parameter_index") == joins
        assert "BroadcastHashJoin [parameter_index" not in physical(df)
    assert sorted(many.select(*SPEC.pair, "chunk", "n", "windows_before").collect()) == sorted(
        small.select(*SPEC.pair, "chunk", "n", "windows_before").collect())
    assert rows.count() == few.count()


def test_large_joins_are_not_broadcast(spark, fact_path):
    """With automatic broadcasts off, as for big tables, rows meet their series by a sort-merge join."""
    panel = pipeline.prepare(spark.read.parquet(fact_path), SPEC)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(panel.features())
        assert "SortMergeJoin [parameter_index" in text
        # but for the counts of the buckets that split labels are ranked in
        assert text.count("BroadcastExchange") == text.count("BroadcastExchange HashedRelationBroadcastMode(List(input[0, string")
        assert panel.features().agg(F.count("*")).first()[0] > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
