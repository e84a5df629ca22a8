"""The ordered sink: order and spans of its files, and ranges read from few of them."""

import pyarrow.parquet as pq

from panelcast.sources import ordered

SCHEMA = "k bigint, s bigint, v string"


def test_files_are_in_order_and_ranges_open_few(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k % 100, k, f"v{k}") for k in range(1_000)] + [(None, 1, "none")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ordered.write_ordered(df.limit(3), path, ["k", "s"], files=2)
    ordered.write_ordered(df, path, ["k", "s"], files=8)
    spans = sorted(ordered.spans(spark, path).collect(), key=lambda r: r.low)
    assert len(spans) == 8 and sum(r.n for r in spans) == 1_001 and sum(r.n_null for r in spans) == 1
    assert all(a.high <= b.low for a, b in zip(spans, spans[1:]))
    for r in spans:
        table = pq.read_table(r.file.removeprefix("file://")).to_pylist()
        keys = [(x["k"] is not None, x["k"] or 0, x["s"]) for x in table]
        assert keys == sorted(keys)
    got = ordered.read_range(spark, path, df.schema, "k", 40, 47)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] is not None and 40 <= r[0] <= 47)
    assert len(got.inputFiles()) <= 3
    assert ordered.read_range(spark, path, df.schema, "k", 500, 600).collect() == []


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([], SCHEMA)
    ordered.write_ordered(df, path, ["k"])
    assert ordered.read_range(spark, path, df.schema, "k", 0, 9).collect() == []
