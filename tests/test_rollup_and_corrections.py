"""The stored daily rollup, and the stream that keeps it in step with replaced labels."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidings.operators import rollup
from tidings.operators import series as S
from tidings.streaming.corrections import run_correcting_stream


def _days(df):
    return {r.date: (r.sentiment, r.n_articles, r.min_label, r.max_label) for r in df.collect()}


def _plain(labels):
    by = defaultdict(list)
    for d, x in labels:
        by[d].append(x)
    return {d: (sum(x) / len(x), len(x), min(x), max(x)) for d, x in by.items()}


def test_states_add_up_and_are_taken_back(spark, tmpdir_path):
    rnd = random.Random(5)
    days = [dt.date(2024, 2, 28) + dt.timedelta(k) for k in range(4)]
    held, store = [], os.path.join(tmpdir_path, "store")
    assert rollup.read_states(spark, store).count() == 0 and rollup.compact(spark, store) == -1
    for k in range(6):
        new = [(rnd.choice(days), rnd.choice([0.0, 0.5, 2.0, 4.0])) for _ in range(8)]
        gone = rnd.sample(held, min(len(held), 5))
        for x in gone:
            held.remove(x)
        held += new
        rows = [(d, x, 1) for d, x in new] + [(d, x, -1) for d, x in gone]
        for _ in range(2):  # written twice, as after a crash
            rollup.write_changes(spark.createDataFrame(rows, "date date, label double, n long"), store, k)
        if k in (2, 3):
            assert rollup.compact(spark, store) == k and rollup.compact(spark, store) == k
        got, want = _days(rollup.daily(rollup.read_states(spark, store))), _plain(held)
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_an_unfinished_base_is_not_read(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    row = spark.createDataFrame([(dt.date(2024, 1, 1), 2.0, 3)], "date date, label double, n long")
    rollup.write_changes(row, store, 0)
    rollup.compact(spark, store)
    os.remove(os.path.join(store, "base", "upto=0", "_SUCCESS"))
    assert _days(rollup.daily(rollup.read_states(spark, store))) == {dt.date(2024, 1, 1): (2.0, 3, 2.0, 2.0)}
    assert rollup.compact(spark, store) == 0


def test_states_of_labels_equal_the_daily_mean(spark):
    rows = [(k % 3, dt.date(2024, 1, 1 + k % 5) if k % 4 else None, float(k % 5) if k % 6 else None) for k in range(100)]
    labels = spark.createDataFrame(rows, "series int, date date, label double")
    states = rollup.day_states(labels, series_cols=["series"])
    got = {(r.series, r.date): (r.sentiment, r.n_articles) for r in rollup.daily(states, ["series"]).collect()}
    want = {(r.series, r.date): (r.sentiment, r.n_articles) for r in S.daily_mean(labels.where("label IS NOT NULL"), series_cols=["series"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_default_range_is_read_once(spark):
    rows = [("a", dt.date(2024, 1, 1), 4.0, 2), ("a", dt.date(2024, 3, 1), 1.0, 1), ("a", dt.date(2024, 3, 31), 2.0, 3), ("b", dt.date(2024, 5, 5), 0.0, 1)]
    daily = spark.createDataFrame(rows, "series string, date date, sentiment double, n_articles long")
    k = {r.series: r for r in S.default_range_kpis(daily, series_cols="series").collect()}
    assert (k["a"].range_start, k["a"].range_end, k["a"].n_days, k["a"].n_articles) == (dt.date(2024, 3, 1), dt.date(2024, 3, 31), 2, 4)
    assert k["a"].mean_sentiment == 1.5 and k["a"].article_mean == 1.75 and k["b"].n_days == 1 and k["b"].range_start == dt.date(2024, 5, 5)
    plan = S.default_range_kpis(daily)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert S.default_range_kpis(daily.limit(0)).count() == 0


def _id(day, k):
    return f"business/2024/mar/{day:02d}/a{k}"


def test_days_follow_replaced_labels(spark, tmpdir_path):
    landing, store, ck = (os.path.join(tmpdir_path, x) for x in ("in", "store", "ck"))
    latest = {}

    def wave(rows):
        spark.createDataFrame(rows, "article_id string, label double, version long").coalesce(1).write.mode("append").parquet(landing)
        run_correcting_stream(spark, landing, store, ck)
        for a, x, v in rows:
            if a and a.startswith("business/2024/") and x is not None and v is not None and (v, x) > latest.get(a, (-1, -1.0)):
                latest[a] = (v, x)
        got = _days(rollup.daily(rollup.read_states(spark, store)))
        want = _plain([(dt.date(2024, 3, int(a.split("/")[3])), x) for a, (v, x) in latest.items()])
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)

    wave([(_id(1, 1), 4.0, 1), (_id(1, 2), 0.0, 1), (_id(2, 3), 2.0, 5), ("no/date", 1.0, 1), (None, 1.0, 1), (_id(3, 9), None, 1), (_id(3, 9), 1.0, None)])
    wave([(_id(1, 1), 1.0, 2), (_id(2, 3), 4.0, 4), (_id(2, 3), 2.0, 5), (_id(4, 4), 3.0, 1), (_id(4, 4), 0.5, 2), (_id(4, 4), 4.0, 1)])  # replaced, outdated, sent again, three at once
    rollup.compact(spark, store)
    wave([(_id(1, 1), 0.0, 3), (_id(1, 2), 2.0, 1), (_id(5, 5), 2.5, 1)])  # of equal versions the larger label
    changes = spark.read.parquet(f"{store}/changes/batch=2")
    assert changes.where(F.col("n") < 0).count() >= 1 and changes.count() <= 5


def test_a_repeated_batch_counts_once(spark, tmpdir_path):
    landing, store, ck = (os.path.join(tmpdir_path, x) for x in ("in", "store", "ck"))
    spark.createDataFrame([(_id(1, 1), 4.0, 1), (_id(2, 2), 1.0, 1)], "article_id string, label double, version long").write.parquet(landing)
    run_correcting_stream(spark, landing, store, ck)
    commits = os.path.join(ck, "commits")
    for f in os.listdir(commits):  # as if the driver had been lost before the batch was committed
        os.remove(os.path.join(commits, f))
    run_correcting_stream(spark, landing, store, ck)
    assert _days(rollup.daily(rollup.read_states(spark, store))) == {dt.date(2024, 3, 1): (4.0, 1, 4.0, 4.0), dt.date(2024, 3, 2): (1.0, 1, 1.0, 1.0)}


class _Map(dict):
    """A map state that counts how often it is asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_one_call_serves_many_articles_and_asks_once_for_each():
    import pandas as pd

    from tidings.streaming.corrections import LatestLabels
    p = LatestLabels()
    p.latest = _Map({("a",): (3, 1.0, 10), ("b",): (1, 2.0, 10), ("c",): (1, 4.0, 11)})
    rows = [("a", 4.0, 2, 10), ("b", 0.0, 2, 10), ("b", 3.0, 2, 10), ("c", 4.0, 1, 11), ("d", 1.0, 1, 12), ("d", 0.0, 1, 12)]
    part = pd.DataFrame(rows, columns=["article_id", "label", "version", "day"])
    out = pd.concat(p.handleInputRows((0,), iter([part]), None))
    assert sorted((r.day, r.label, r.n) for r in out.itertuples() if r.n) == [(10, 2.0, -1), (10, 3.0, 1), (12, 1.0, 1)]
    assert p.latest.asked == 4 and p.latest[("b",)] == (2, 3.0, 10) and p.latest[("a",)] == (3, 1.0, 10)
    assert list(p.handleInputRows((0,), iter([part]), None)) == []  # the same rows again change nothing


def test_articles_of_one_bucket_stay_apart(spark, tmpdir_path, monkeypatch):
    from tidings.streaming import corrections
    monkeypatch.setattr(corrections, "BUCKETS", 1)
    landing, store, ck = (os.path.join(tmpdir_path, x) for x in ("in", "store", "ck"))
    for version, label in ((1, 1.0), (2, 3.0)):
        rows = [(_id(1 + k % 3, k), label if k % 2 else 2.0, version) for k in range(30)]
        spark.createDataFrame(rows, "article_id string, label double, version long").write.mode("append").parquet(landing)
        run_correcting_stream(spark, landing, store, ck)
        got = _days(rollup.daily(rollup.read_states(spark, store)))
        assert got == {dt.date(2024, 3, 1 + d): ((2.0 + label) / 2, 10, min(label, 2.0), max(label, 2.0)) for d in range(3)}
