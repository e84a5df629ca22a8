"""Saved tables that are replaced whole: writers that die, two writers, readers in between."""

from pathlib import Path

import pytest

from panelcast.operators import forecast
from panelcast.sources import records, versions

SCHEMA = "k bigint, v string, part string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, path, kind="json"):
    return sorted(map(tuple, versions.read(spark, path, kind, SCHEMA).collect()), key=str)


def test_a_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.write(table(spark, [(1, "a", "x")]), path, "parquet")

    class Killed(Exception):
        pass

    def die(*_):
        raise Killed

    with monkeypatch.context() as m:  # the new version is written, the switch never happens
        m.setattr(versions, "_switch", die)
        with pytest.raises(Killed):
            versions.write(table(spark, [(2, "b", "x")]), path, "parquet")
    assert content(spark, path, "parquet") == [(1, "a", "x")]
    bad = table(spark, [(2, "b", "x")]).selectExpr("k", "CAST(raise_error('dies') AS STRING) AS v", "part")
    with pytest.raises(Exception, match="dies"):
        versions.write(bad, path, "parquet")
    assert content(spark, path, "parquet") == [(1, "a", "x")]
    versions.write(table(spark, [(3, "c", "x")]), path, "parquet")
    assert content(spark, path, "parquet") == [(3, "c", "x")]


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.write(table(spark, [(1, "a", "x")]), path, "json")
    began = versions.latest(spark, path)
    versions.write(table(spark, [(2, "b", "x")]), path, "json")
    with monkeypatch.context() as m:
        m.setattr(versions, "latest", lambda *_: began)
        with pytest.raises(versions.ConcurrentWrite):
            versions.write(table(spark, [(3, "c", "x")]), path, "json")
    assert content(spark, path) == [(2, "b", "x")]
    assert len(list(Path(path).glob("v-*"))) == 2  # the refused version is gone


def test_folders_by_key_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(table(spark, [(1, "a", "x"), (2, "b", "y/=%[z")]), path, "json", ("part",))
    versions.write(table(spark, [(3, "c", "x")]), path, "json", ("part",))
    versions.write(table(spark, []), path, "json", ("part",))
    assert content(spark, path) == [(2, "b", "y/=%[z"), (3, "c", "x")]
    versions.write(table(spark, [(4, "d", "w"), (5, "e", "y/=%[z")]), path, "json", ("part",))
    assert content(spark, path) == [(3, "c", "x"), (4, "d", "w"), (5, "e", "y/=%[z")]


def test_a_reader_outlives_one_switch_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(table(spark, [(0, "a", "x")]), path, "json")
    reader = versions.read(spark, path, "json", SCHEMA)
    versions.write(table(spark, [(1, "a", "x")]), path, "json")
    assert [r.k for r in reader.collect()] == [0]
    for k in range(2, 5):
        versions.write(table(spark, [(k, "a", "x")]), path, "json")
    assert len(list(Path(path).glob("v-*"))) == 2 and len(list(Path(path).glob("_manifests/*.json"))) == 2
    assert content(spark, path) == [(4, "a", "x")]


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    table(spark, [(1, "a", "x")]).write.json(path)
    assert content(spark, path) == [(1, "a", "x")] and records.is_complete(spark, path)
    assert not records.exists(spark, str(tmp_path / "none")) and not records.is_complete(spark, str(tmp_path / "none"))


def test_histories_of_two_models_live_together(spark, tmp_path):
    path = str(tmp_path / "history")
    both = [("linear", 0, 1, 0.5, 0.25), ("boosted", 1, 1, 0.4, None), ("boosted", 1, 2, 0.3, 0.2)]
    records.write_history(spark.createDataFrame(both[:1], forecast.HISTORY_SCHEMA), path)
    records.write_history(spark.createDataFrame([("boosted", 9, 9, 9.0, 9.0)], forecast.HISTORY_SCHEMA), path)
    records.write_history(spark.createDataFrame(both[1:], forecast.HISTORY_SCHEMA), path)
    assert sorted(map(tuple, records.read_history(spark, path).collect()), key=str) == sorted(both, key=str)
