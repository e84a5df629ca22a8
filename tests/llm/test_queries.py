"""Queries of the text operators that SQL can express, against DuckDB over the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from panelcast.llm.queries import ORACLE, QUERIES

TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, str(TABLES)).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (df[columns].sort_values(columns, ignore_index=True) for df in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
