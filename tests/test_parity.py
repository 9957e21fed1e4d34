"""Every registered query of the engine against its SQL twin, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gristmill import catalogue


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = rows_of(df.columns, df.collect())
    if name not in catalogue.ORACLES:
        assert found
        return
    twin = tables.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert found == rows_of(list(twin.columns), twin.fetchall())


def test_plans_have_no_python(spark, sf_dir):
    for name in ("lifecycle_episodes", "strategy_leave_one_out", "risk_ranking_metrics", "audit_slice_profile"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan
