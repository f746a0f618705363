"""Registered queries against their DuckDB SQL, and their contracts."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tidings.llm import catalog

TYPES = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR", "BooleanType": "BOOLEAN"}


def _norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def _sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = _sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {f.name: TYPES[type(f.dataType).__name__] for f in df.schema.fields} == kinds
    at = [rel.columns.index(c) for c in cols]
    assert got == _sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names


@pytest.mark.parametrize("name", [f"op{n}" for n in (1, 3, 4)])
def test_native_plans_hold_no_python(spark, name):
    df = E.queries()[next(k for k in catalog.QUERIES if k.startswith(name + "_"))](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
