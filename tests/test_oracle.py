"""Every registered query against its SQL on DuckDB, over the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from panelcast.plans.oracle import ORACLE
from panelcast.plans.queries import QUERIES
from panelcast.sources.stage import staging_scope

TABLES = Path("/root/testdata/sf0.001")
ROWS_ONLY = {"fit_score", "fit_shape_natural", "training_history", "early_stop", "tune", "tune_fit_compare"}

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, duck, name):
    with staging_scope():
        got = QUERIES[name](spark, str(TABLES)).toPandas()
    want = duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got = got[columns].sort_values(columns, ignore_index=True)
    want = want[columns].sort_values(columns, ignore_index=True)
    assert len(got) == len(want) > 0
    for c in columns:
        equal = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert equal.all(), (c, got[c][~equal].head(), want[c][~equal].head())


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_model_queries_give_rows(spark, name):
    with staging_scope():
        assert QUERIES[name](spark, str(TABLES)).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
