"""Windows over slices equal windows over whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.operators.series import rolling_mean
from tidings.operators.sliced import sliced_features


def _whole(df, fill=True, rolling=5, lags=(1, 2, 3, 4, 5)):
    w = Window.partitionBy("symbol").orderBy("k")
    filled = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col("close")
    d = df.withColumn("_f", filled)
    d = d.withColumn("return", F.try_divide("_f", F.lag("_f").over(w)) - 1.0)
    return d.select("symbol", "k", "return", rolling_mean("return", w, rolling).alias("return_smoothed"), rolling_mean("x", w, rolling).alias("x_smoothed"),
                    *[F.lead("return", n).over(w).alias(f"return_lead{n}") for n in lags])


def _rows(df):
    return {(r.symbol, r.k): tuple(None if v is None else round(v, 9) for v in r[2:]) for r in df.collect()}


@pytest.mark.parametrize("slice_rows,fill", [(5, True), (7, True), (64, True), (10_000, True), (6, False)])
def test_slices_equal_whole_series(spark, slice_rows, fill):
    rnd = random.Random(slice_rows)
    rows = [("long", k, None if rnd.random() < 0.3 or 40 <= k < 75 else rnd.uniform(1, 9), float(k % 4)) for k in range(230)]  # a gap longer than several slices
    rows += [("start", k, None if k < 20 else 2.0 + k, 1.0) for k in range(33)] + [("never", k, None, 2.0) for k in range(12)] + [("one", 0, 5.0, None), (None, 0, 1.0, 1.0), (None, 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, k int, close double, x double").repartition(5)
    got = sliced_features(df, ["k"], smooth=("x",), slice_rows=slice_rows, fill_gaps=fill)
    assert got.columns == ["symbol", "k", "close", "x", "return", "return_smoothed", "x_smoothed", *[f"return_lead{n}" for n in (1, 2, 3, 4, 5)]]
    assert _rows(got.drop("close", "x")) == _rows(_whole(df, fill))


def test_other_windows_and_no_slice_holds_a_series(spark):
    df = spark.range(500).select(F.lit("s").alias("symbol"), F.col("id").cast("int").alias("k"), (F.col("id") % 11 + 1.0).alias("close"), F.lit(1.0).alias("x"))
    got = sliced_features(df, ["k"], smooth=("x",), rolling=3, lags=(1, 7), slice_rows=20)
    assert _rows(got.drop("close", "x")) == _rows(_whole(df, rolling=3, lags=(1, 7)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_slice" in plan
    windows = [line for line in plan.splitlines() if "Window [" in line and "_i#" in line]
    assert windows and all("_slice#" in line for line in windows)  # no window over a whole series of rows
    with pytest.raises(ValueError, match="at least 7"):
        sliced_features(df, ["k"], lags=(1, 7), slice_rows=6)
    assert sliced_features(df.limit(0), ["k"], slice_rows=20).count() == 0
