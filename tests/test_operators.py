"""Operators: labels, series, metrics, profile (FIXTURES.md 6 + invariants of SURVEY 5)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidings.operators import labels as L
from tidings.operators import metrics as M
from tidings.operators import profile as PR
from tidings.operators import series as S


def test_consensus_half_even(spark):
    pairs = [("p1", 0, 1), ("p2", 1, 2), ("p3", 2, 3), ("p4", 3, 4), ("p5", None, 1), ("p6", 3, None)]
    rows = [(i, "a", float(a)) for i, a, _ in pairs if a is not None] + \
           [(i, "b", float(b)) for i, _, b in pairs if b is not None]
    df = spark.createDataFrame(rows, "article_id string, rater string, label double")
    got = {r.article_id: r.label for r in L.consensus(df).collect()}
    assert got == {"p1": 0.0, "p2": 2.0, "p3": 2.0, "p4": 4.0, "p5": 1.0, "p6": 3.0}
    unrounded = {r.article_id: r.label for r in L.consensus(df, rounded=False).collect()}
    assert unrounded["p1"] == 0.5 and unrounded["p4"] == 3.5


def test_merge_and_stats(spark):
    rows = [("x", 1.0, "a", 0), ("y", 2.0, "a", 1), ("y", 3.0, "b", 0), ("z", 4.0, "b", 1)]
    df = spark.createDataFrame(rows, "article_id string, label double, src_file string, pos int")
    merged = {r.article_id: r.label for r in L.merge_label_files(df).collect()}
    assert merged == {"x": 1.0, "y": 3.0, "z": 4.0}
    st = {r.file: (r.labels_in_file, r.new_labels, r.duplicates) for r in L.merge_file_stats(df).collect()}
    assert st == {"a": (2, 2, 0), "b": (2, 1, 1)}


def test_merge_idempotent_and_order_free(spark):
    rows = [("x", 1.0, "f1", 0), ("x", 2.0, "f2", 0), ("y", 5.0, "f1", 1)]
    df = spark.createDataFrame(rows, "article_id string, label double, src_file string, pos int")
    a = sorted(L.merge_label_files(df).collect())
    b = sorted(L.merge_label_files(df.union(df).orderBy(F.rand(1))).collect())
    assert a == b


def test_agreement_counts_add_up(spark):
    rows = [("1", "a", 1.0), ("1", "b", 3.0), ("2", "a", 2.0), ("3", "b", 4.0), ("4", "a", 0.0), ("4", "b", 0.0)]
    df = spark.createDataFrame(rows, "article_id string, rater string, label double")
    r = L.rater_agreement(L.pair_wide(df, "a", "b")).first()
    assert (r.both, r.only_a, r.only_b, r.total) == (2, 1, 1, 4)
    assert r.both + r.only_a + r.only_b == r.total
    assert r.mean_abs_diff == 1.0 and r.max_abs_diff == 2.0 and r.n_differ == 1


def test_label_distribution_zero_fill(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (4.0,), (2.5,)], "label double")
    got = {r["label"]: (r["count"], r["pct"]) for r in L.label_distribution(df).collect()}
    assert got == {0: (0, 0.0), 1: (0, 0.0), 2: (2, 50.0), 3: (0, 0.0), 4: (1, 25.0)}
    empty = spark.createDataFrame([], "label double")
    assert L.label_distribution(empty).count() == 0 or \
        all(r.pct == 0.0 for r in L.label_distribution(empty).collect())


def test_overlap_sets(spark):
    a = spark.createDataFrame([("1",), ("2",), ("3",)], "article_id string")
    b = spark.createDataFrame([("2",), ("4",)], "article_id string")
    r = L.overlap_sets(a, b).first()
    assert (r.both, r.only_left, r.only_right) == (1, 2, 1)


def test_returns_gap_filled(spark):
    rows = [("s", dt.datetime(2024, 1, d), c) for d, c in [(1, 1.0), (2, None), (3, 3.0)]]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    r = [x["return"] for x in S.daily_returns(df).orderBy("date").collect()]
    assert r[0] is None and r[1] == 0.0 and r[2] == 2.0


def test_rolling_mean(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([("s", i, float(i)) for i in range(7)], "k string, t int, x double")
    w = Window.partitionBy("k").orderBy("t")
    got = [x[0] for x in df.select("t", S.rolling_mean("x", w, 5).alias("m")).orderBy("t").select("m").collect()]
    assert got == [None, None, None, None, 2.0, 3.0, 4.0]


def test_safe_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0), (4.0, 5.0)], "x double, y double")
    assert math.isclose(df.select(M.safe_corr("x", "y")).first()[0], 0.944911182523068, rel_tol=1e-12)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 5.0)], "x double, y double")
    assert const.select(M.safe_corr("x", "y")).first()[0] is None
    single = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert single.select(M.safe_corr("x", "y")).first()[0] is None
    withnull = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0), (4.0, 5.0), (9.0, None)], "x double, y double")
    assert math.isclose(withnull.select(M.safe_corr("x", "y")).first()[0], 0.944911182523068, rel_tol=1e-12)


def same(a, b):
    """Our NULL equals pandas' NaN; numbers compare with a relative tolerance."""
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and not math.isnan(b) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def _series_fixture(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    sent = spark.createDataFrame([("A", d, float(i % 5), 3) for i, d in enumerate(days)] +
                                 [("B", d, float((i * 3) % 5), 2) for i, d in enumerate(days)],
                                 "series string, date date, sentiment double, n_articles long")
    prices = spark.createDataFrame(
        [("A", dt.datetime.combine(d, dt.time()), 100.0 + i * i) for i, d in enumerate(days)] +
        [("B", dt.datetime.combine(d, dt.time()), 50.0 + (i % 3)) for i, d in enumerate(days)],
        "symbol string, ts timestamp, close double")
    return sent, prices


def test_market_stats_against_pandas(spark):
    import pandas as pd
    sent, prices = _series_fixture(spark)
    comb = S.combine(sent, S.daily_returns(prices), "series", on_symbol="symbol")
    stats = {r.series: r for r in S.market_stats(comb).collect()}
    lags = {(r.series, r.lag): r["corr"] for r in S.lag_correlations(comb).collect()}
    for series in ("A", "B"):
        s = sent.where(F.col("series") == series).toPandas().set_index("date")["sentiment"]
        p = prices.where(F.col("symbol") == series).toPandas().sort_values("ts")
        ret = p["close"].pct_change()
        ret.index = p["ts"].dt.date
        c = pd.DataFrame({"s": s}).join(pd.DataFrame({"r": ret}), how="inner").sort_index()
        exp = c["s"].corr(c["r"])
        assert same(stats[series]["corr"], exp)
        assert same(lags[(series, 0)], exp)
        exp2 = c["s"].corr(c["r"].shift(-2))
        assert same(stats[series]["corr_lag2"], exp2)
        sm = c["s"].rolling(5).mean().corr(c["r"].rolling(5).mean())
        assert same(stats[series]["corr_smoothed"], sm)
        nr = c["r"].shift(-1)
        sd = c["s"].apply(lambda x: 1 if x > 2 else (-1 if x < 2 else 0))
        rd = nr.apply(lambda x: 1 if x > 0 else (-1 if x < 0 else 0))
        mask = (sd != 0) & (rd != 0)
        assert stats[series]["dir_days"] == int(mask.sum())
        if mask.sum():
            assert same(stats[series]["dir_accuracy"], float((sd[mask] == rd[mask]).mean()))


def test_series_windows_are_partitioned(spark):
    sent, prices = _series_fixture(spark)
    comb = S.combine(sent, S.daily_returns(prices), "series", on_symbol="symbol")
    plan = comb._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_kpis_and_range(spark):
    rows = [(dt.date(2024, 1, 1), 1.0, 2), (dt.date(2024, 1, 20), 3.0, 1), (dt.date(2024, 2, 5), 0.0, 4)]
    daily = spark.createDataFrame(rows, "date date, sentiment double, n_articles long")
    rng = S.data_range(daily).first()
    assert rng.default_start == dt.date(2024, 1, 6) and rng.max_date == dt.date(2024, 2, 5)
    k = S.default_range_kpis(daily).first()
    assert (k.n_days, k.n_articles, k.mean_sentiment, k.min_sentiment, k.max_sentiment) == (2, 5, 1.5, 0.0, 3.0)
    assert math.isclose(k.article_mean, 3.0 / 5)
    k2 = S.range_kpis(daily, "2024-01-01", "2024-01-20").first()
    assert k2.n_days == 2 and k2.mean_sentiment == 2.0


def test_price_range(spark):
    rows = [("s", dt.date(2024, 1, d), 1.0) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert S.price_range(df, "2024-01-03", "2024-01-06").count() == 3
    assert S.price_range(df, period_days=3).count() == 3


def _preds(spark):
    rows = [("m", 0, 0), ("m", 0, 1), ("m", 1, 1), ("m", 2, 2), ("m", 2, -1), ("m", 4, 3), ("m", 3, 3)]
    return spark.createDataFrame(rows, "model string, y_true int, y_pred int")


def test_confusion_and_summary(spark):
    p = _preds(spark)
    cm = M.confusion_matrix(p)
    assert cm.count() == 25
    assert cm.agg(F.sum("n")).first()[0] == 6  # the -1 row is out of range
    s = M.evaluation_summary(p).first()
    assert s.n == 7 and s.unparseable == 1
    assert math.isclose(s.accuracy, 4 / 7)
    assert math.isclose(s.mae, (0 + 1 + 0 + 0 + 3 + 1 + 0) / 7)


def test_classification_report_matches_hand_computation(spark):
    p = _preds(spark)
    rep = {r.row: r for r in M.classification_report(p, classes=[0, 1, 2, 3, 4]).collect()}
    # class 3: tp=1, predicted=2, support=1 -> p=.5 r=1 f1=2/3
    assert math.isclose(rep["3"].precision, 0.5) and rep["3"].recall == 1.0
    assert math.isclose(rep["3"].f1, 2 / 3)
    assert rep["4"].precision == 0.0 and rep["4"].f1 == 0.0 and rep["4"].support == 1
    assert math.isclose(rep["accuracy"].f1, 4 / 7)
    assert math.isclose(rep["macro avg"].recall, (0.5 + 1 + 0.5 + 1 + 0) / 5)
    assert rep["weighted avg"].support == 7
    # micro average over the listed labels excludes the -1 prediction
    assert math.isclose(rep["micro avg"].precision, 4 / 6)
    seen = {r.row for r in M.classification_report(p).collect()}
    assert "-1" in seen


def test_histogram_and_agreement(spark):
    rows = [("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("b", "2", 3)]
    p = spark.createDataFrame(rows, "model string, article_id string, y_pred int")
    h = {r.score: (r.a, r.b) for r in M.prediction_histogram(p, ["a", "b"]).collect()}
    assert h == {1: (1, 1), 2: (1, 0), 3: (0, 1)}
    wide = spark.createDataFrame([(1, 1), (2, 3), (3, 3)], "pred_a int, pred_b int")
    r = M.agreement(wide).first()
    assert math.isclose(r.agreement, 2 / 3)


def test_profile_statistics(spark):
    rows = [("1", "article", "2024-01-02T00:00:00Z", "a b c"), ("2", "article", "2024-03-01T10:00:00Z", None),
            ("3", None, "", "x"), ("4", "liveblog", None, "one two")]
    df = spark.createDataFrame(rows, "id string, type string, webPublicationDate string, bodyText string")
    st = {r.type: r for r in PR.type_statistics(df).collect()}
    assert st["article"]["count"] == 2 and st["article"].min_date == dt.date(2024, 1, 2)
    assert st["article"].avg_word_count == 3.0 and st["article"].max_word_count == 3
    assert st["unknown"].min_date is None and st["unknown"].avg_word_count == 1.0
    tot = {r.type: r for r in PR.type_statistics_with_total(df).collect()}
    assert tot["all"]["count"] == 4 and tot["all"].max_word_count == 3
    assert PR.drop_liveblogs(df).count() == 3  # null type stays
    chk = PR.data_check(df).first()
    assert (chk.total, chk.with_body) == (4, 3)


def test_row_index_and_range(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    idx = PR.with_row_index(df, "k")
    got = idx.select("k", "idx").collect()
    assert all(r.k == r.idx for r in got) and len(got) == 5000
    rng = PR.index_range(df, 4990, 50, "k")
    assert sorted(r.idx for r in rng.collect()) == list(range(4990, 5000))
    assert PR.index_range(df, 6000, 10, "k").count() == 0


def test_newest(spark):
    rows = [("a", "2024-01-01"), ("b", "2024-03-01"), ("c", "2024-02-01")]
    df = spark.createDataFrame(rows, "id string, webPublicationDate string")
    assert [r.id for r in PR.newest(df, 2).collect()] == ["b", "c"]


def test_hot_keys_are_combined_map_side(spark):
    """One day / one id / one file holding a third of all rows: the aggregates
    still run with a partial (map-side) step before the shuffle, so only one
    partial row per hot key and task is exchanged."""
    n = 30000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("article_id"),
        F.when(F.col("id") % 3 == 0, F.lit("r")).otherwise(F.lit("s")).alias("rater"),
        (F.col("id") % 5).cast("double").alias("label"),
        F.when(F.col("id") % 3 == 0, F.lit("f1")).otherwise(F.lit("f2")).alias("src_file"),
        F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") % 3 == 0, F.lit(dt.date(2024, 1, 1))).otherwise(
            F.date_add(F.lit(dt.date(2024, 1, 2)), (F.col("id") % 300).cast("int"))).alias("date"))
    plans = {
        "consensus": L.consensus(rows),
        "merge": L.merge_label_files(rows),
        "daily": S.daily_mean(rows),
        "stats": L.merge_file_stats(rows),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan, name
    daily = {r.date: r.n_articles for r in plans["daily"].collect()}
    assert daily[dt.date(2024, 1, 1)] == n // 3
    assert plans["consensus"].where(F.col("article_id") == "hot").first().n_raters == n // 3


def test_trading_day_alignment(spark):
    """Q9: joined-row leads skip days without articles; trading-day leads do not."""
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    prices = spark.createDataFrame([("s", d, 100.0 + i * i) for i, d in enumerate(days)],
                                   "symbol string, date date, close double")
    sent = spark.createDataFrame([("s", d, float(i % 3), 1) for i, d in enumerate(days) if i % 2 == 0],
                                 "series string, date date, sentiment double, n_articles long")
    joined = {r.date: r for r in S.combine_prices(sent, prices).collect()}
    trading = {r.date: r for r in S.combine_prices(sent, prices, align="trading").collect()}
    assert set(joined) == set(trading) == {days[0], days[2], days[4], days[6]}
    ret = {d: (100.0 + i * i) / (100.0 + (i - 1) ** 2) - 1 for i, d in enumerate(days) if i}
    assert math.isclose(joined[days[0]].next_return, ret[days[2]])   # next joined row
    assert math.isclose(trading[days[0]].next_return, ret[days[1]])  # next trading day
    assert trading[days[6]].next_return == ret[days[7]] and joined[days[6]].next_return is None


def test_one_pass_e1_is_partitioned_by_series(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    prices = spark.createDataFrame([(s, d, 10.0 + i) for s in "AB" for i, d in enumerate(days)],
                                   "symbol string, date date, close double")
    sent = spark.createDataFrame([(s, d, float(i % 5), 1) for s in "AB" for i, d in enumerate(days)],
                                 "series string, date date, sentiment double, n_articles long")
    stats = S.market_stats(S.combine_prices(sent, prices, "series"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "Window" in plan and stats.count() == 2
