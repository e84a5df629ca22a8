"""Searches that share a driver: staging scopes by context, trials that are cancelled, local properties in trial threads."""

import threading
import time

import pytest
import small

from panelcast.operators import tuning
from panelcast.plans import pipeline
from panelcast.sources import stage

SPEC = small.SPEC


@pytest.fixture(scope="module")
def features(spark):
    panel = pipeline.prepare(spark.createDataFrame(small.facts()), SPEC)
    return stage.stage(pipeline.features_with_windows(panel, (4,)), "features")


def test_a_scope_ends_only_its_own_tables(spark):
    """Two threads stage side by side, and the scope that ends first takes nothing of the other."""
    staged, go, done = {}, threading.Event(), threading.Event()

    def other():
        with stage.staging_scope():
            staged["other"] = stage.stage(spark.range(5), "scoped")
            go.set()
            done.wait(60)
            staged["count"] = staged["other"].count()

    with stage.staging_scope():
        thread = threading.Thread(target=other)
        thread.start()
        assert go.wait(60)
        own = stage.stage(spark.range(7), "scoped")
        with stage.staging_scope():
            inner = stage.stage(spark.range(3), "scoped")
        with pytest.raises(Exception):
            inner.count()
        assert own.count() == 7
    with pytest.raises(Exception):
        own.count()
    done.set()
    thread.join()
    assert staged["count"] == 5


def test_trials_stage_in_the_callers_scope(spark, features, monkeypatch):
    made = []

    def trial(candidate, rows, spec):
        made.append((stage.stage(spark.range(candidate.number + 1), "trial"), spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
        return (candidate.number, candidate.family, {}, 1.0, 1, "COMPLETE")

    monkeypatch.setattr(tuning, "run_trial", trial)
    drawn = tuning.candidates("boosted", 4, SPEC, (4,))
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "searches")
    try:
        with stage.staging_scope():
            tuning.one_by_one(drawn, features, SPEC, parallel_trials=2)
            assert sorted(t.count() for t, _ in made) == [1, 2, 3, 4]
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    assert {pool for _, pool in made} == {"searches"}
    for table, _ in made:
        with pytest.raises(Exception):
            table.count()


def test_running_trials_are_cancelled_at_the_deadline(features):
    drawn = [tuning.Candidate(k, "boosted", 4, {"maxIter": 100, "maxDepth": 5, "seed": 1}) for k in range(2)]
    start = time.monotonic()
    found = tuning.one_by_one(drawn, features, SPEC, deadline=start + 3)
    assert [f[-1] for f in found] == ["CANCELLED", "SKIPPED"] and all(f[3] == float("inf") for f in found)
    assert features.count() > 0  # other jobs of the session go on
