"""Scale hazards in the physical plans of every registered query: no
cartesian product, no nested-loop join, no row-at-a-time Python UDF, no text in a
sorted aggregate, scans that read only the columns they need."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF001
from tidings.plans.catalog import QUERIES

# model fits: their plans are ML internals
FITS = {"tfidf_logreg_eval", "baseline_models", "regularisation_by_mae"}
TEXT = re.compile(r"bodyText|standfirst|(?<![a-z_])text#|raw_response|_text#")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_no_plan_hazards(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    for line in plan.split("\n"):
        if "SortAggregate" in line:
            assert not TEXT.search(line), line
        if re.search(r"Window \[", line):
            assert ", [], [" not in line or "_range" in line or "date" in line, line


def test_scans_are_pruned(spark):
    df = E.queries()["daily_sentiment"](spark, SF001)
    fmt = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = [line for line in fmt.split("\n") if line.startswith("ReadSchema")]
    assert schemas and all("text" not in s for s in schemas)
    assert any("PushedFilters: [IsNotNull(lang)" in line for line in fmt.split("\n"))
