"""Sources and sinks round trips (S1-S9, K1-K5) through temporary folders."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidings.operators import labels as L
from tidings.sources import readers as RD
from tidings.sources import writers as WR


def art(i, title="t", typ="article", body="some body", date="2024-01-02T10:00:00Z"):
    a = {"id": i, "type": typ, "webTitle": title, "webUrl": f"https://x/{i}", "webPublicationDate": date,
         "fields": {"headline": title, "standfirst": "<p>s</p>", "bodyText": body}}
    if typ is None:
        del a["type"]
    return a


def write_json(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f)


def test_read_articles_array(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "articles_1.json")
    write_json(p, [art("a/1"), art("a/2", typ=None), {"id": "a/3"}])
    df = RD.read_articles(spark, p)
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {"a/1", "a/2", "a/3"}
    assert rows["a/2"].type is None and rows["a/3"].bodyText is None
    assert rows["a/1"].standfirst == "<p>s</p>"


def test_snapshots_latest_file_wins(spark, tmpdir_path):
    p1, p2 = os.path.join(tmpdir_path, "snap_1.json"), os.path.join(tmpdir_path, "snap_2.json")
    write_json(p1, [art("a/1", "old"), art("a/2", "keep"), {"type": "article"}])
    write_json(p2, [art("a/1", "new")])
    os.utime(p1, (time.time() - 100, time.time() - 100))
    df = RD.read_article_snapshots(spark, [p1, p2])
    got = {r.id: r.webTitle for r in df.collect()}
    assert got == {"a/1": "new", "a/2": "keep"}
    latest = RD.latest_snapshot(spark, [p1, p2])
    assert [r.id for r in latest.collect()] == ["a/1"]


def test_snapshots_lose_no_article_when_joins_are_planned_differently(spark, tmpdir_path):
    """Narrow rows and rows with bodies differ enough in size for AQE to change the join of one only."""
    for k in range(6):
        spark.range(400 * (k % 3), 400 * (k % 3) + 800).select(
            F.concat(F.lit("a/"), F.col("id")).alias("id"), F.lit(f"run {k}").alias("webTitle"),
            F.struct(F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("bodyText")).alias("fields")) \
            .repartition(3).write.json(os.path.join(tmpdir_path, f"snap_{k}"))
        when = time.time() - 1000 + 100 * k
        for f in os.listdir(os.path.join(tmpdir_path, f"snap_{k}")):
            os.utime(os.path.join(tmpdir_path, f"snap_{k}", f), (when, when))
    got = RD.read_article_snapshots(spark, [os.path.join(tmpdir_path, f"snap_{k}") for k in range(6)], multiline=False).collect()
    # runs 3, 4 and 5 hold the ids from 0, 400 and 800, so each id's last run is known
    want = {f"a/{i}": f"run {3 if i < 400 else 4 if i < 800 else 5}" for i in range(1600)}
    assert len(got) == 1600 and {r.id: r.webTitle for r in got} == want
    assert all(len(r.bodyText) == 2560 for r in got)


def test_label_map_duplicate_key_and_errors(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "labels")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"a": 1, "b": 2.5, "a": 3}')
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('{"b": 4, "c": 0}')
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write('{"a": 1,')
    long = RD.read_label_map(spark, d, rater="x")
    a_rows = {r.article_id: r.label for r in long.where(F.col("src_file") == "a.json").collect()}
    assert a_rows == {"a": 3.0, "b": 2.5}
    merged = {r.article_id: r.label for r in L.merge_label_files(long).collect()}
    assert merged == {"a": 3.0, "b": 4.0, "c": 0.0}
    assert [r.src_file for r in RD.label_map_errors(spark, d).collect()] == ["broken.json"]
    ints = {r.article_id: r.label for r in RD.read_label_map(spark, os.path.join(d, "a.json"), as_int=True).collect()}
    assert ints["b"] == 2.0


def test_prediction_run(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "run.json")
    write_json(p, {"model": "m", "timestamp": "t", "batch_size": 32,
                   "zero_shot": {"accuracy": 0.5, "predictions": {"x": 1, "y": 2}},
                   "few_shot": {"accuracy": 1.0, "predictions": {"x": 2, "y": 2}},
                   "ground_truth": {"x": 2, "y": 2}})
    preds, truth = RD.read_prediction_run(spark, p)
    assert preds.count() == 4 and truth.count() == 2
    j = preds.join(truth, ["run", "article_id"])
    acc = {r.mode: r.acc for r in j.groupBy("mode").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))
                                                         .alias("acc")).collect()}
    assert acc == {"zero_shot": 0.5, "few_shot": 1.0}
    rec = WR.run_record(preds.drop("run"), truth.drop("run"), "m", "t", 32).first()
    assert rec.zero_shot.accuracy == 0.5 and rec.ground_truth == {"x": 2, "y": 2}
    out = os.path.join(tmpdir_path, "out")
    WR.write_json_report(WR.run_record(preds.drop("run"), truth.drop("run"), "m", "t", 32), out)
    preds2, _ = RD.read_prediction_run(spark, out)
    assert preds2.count() == 4


def test_prices_csv_utc(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "prices.csv")
    with open(p, "w") as f:
        f.write("Date,Open,Close\n2024-02-14 00:00:00-05:00,1,10\n2024-02-15 00:00:00-05:00,1,11\n"
                "2024-02-15 22:00:00-05:00,1,12\n")
    df = RD.read_prices(spark, p, symbol="SPY")
    rows = df.orderBy("ts").collect()
    assert rows[0].ts == dt.datetime(2024, 2, 14, 5, 0)  # session time zone is UTC
    from tidings.operators.series import daily_returns
    d = [r.date for r in daily_returns(df).orderBy("ts").collect()]
    assert d == [dt.date(2024, 2, 14), dt.date(2024, 2, 15), dt.date(2024, 2, 16)]


def test_assemble_pages_stops_at_failure(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "pages")
    os.makedirs(d)
    pages = [(1, "ok", [art("p1/a"), art("p1/b")]), (2, "ok", [art("p2/a")]), (3, "error", [art("p3/a")]),
             (4, "ok", [art("p4/a")])]
    for n, st, res in pages:
        write_json(os.path.join(d, f"page_{n}.json"), {"page": n, "response": {"status": st, "pages": 4, "results": res}})
    df = RD.assemble_pages(RD.read_search_pages(spark, d))
    assert sorted(r.id for r in df.collect()) == ["p1/a", "p1/b", "p2/a"]
    capped = RD.assemble_pages(RD.read_search_pages(spark, d), max_articles=2)
    assert [r.id for r in capped.collect()] == ["p1/a", "p1/b"]
    write_json(os.path.join(d, "page_2.json"), {"page": 2, "response": {"status": "ok", "pages": 4, "results": []}})
    assert RD.assemble_pages(RD.read_search_pages(spark, d)).count() == 2


def test_collection_window(spark):
    rows = [("a", "2024-01-01T00:00:00Z"), ("b", "2025-12-31T23:00:00Z"), ("c", "2023-12-31T00:00:00Z")]
    df = spark.createDataFrame(rows, "id string, webPublicationDate string")
    got = sorted(r.id for r in RD.collection_window(df, "2025-12-31", 730).collect())
    assert got == ["a", "b"]


def test_writers(spark, tmpdir_path):
    rows = [("1", "article", 1.0), ("2", None, 2.0), ("3", "liveblog", 3.0)]
    df = spark.createDataFrame(rows, "id string, type string, label double")
    WR.write_by_type(df, os.path.join(tmpdir_path, "bytype"))
    folders = sorted(x for x in os.listdir(os.path.join(tmpdir_path, "bytype")) if x.startswith("type="))
    assert folders == ["type=article", "type=liveblog", "type=unknown"]
    back = spark.read.json(os.path.join(tmpdir_path, "bytype"))
    assert back.where(F.col("type") == "unknown").count() == 1
    WR.write_table(df, os.path.join(tmpdir_path, "pq"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "pq")).count() == 3
    comb = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0)], "series string, date date, sentiment double")
    WR.write_series_csv(comb, os.path.join(tmpdir_path, "csv"))
    txt = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).first()
    assert txt.date == "2024-01-01"


def test_bucketed_tables_join_without_shuffle(spark, tmpdir_path):
    a = spark.range(1000).select(F.col("id").cast("string").alias("article_id"), (F.col("id") % 5).alias("x"))
    b = spark.range(1000).select(F.col("id").cast("string").alias("article_id"), (F.col("id") % 3).alias("y"))
    WR.write_bucketed(a, "t_bucket_a", os.path.join(tmpdir_path, "a"), buckets=8)
    WR.write_bucketed(b, "t_bucket_b", os.path.join(tmpdir_path, "b"), buckets=8)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_bucket_a").join(spark.table("t_bucket_b"), "article_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 1000 and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_scale_conf():
    from tidings.session import scale_conf
    c = scale_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 819200
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_dated_labels_prune_partitions(spark, tmpdir_path):
    rows = [("b/2024/jan/05/a", 1.0), ("b/2024/feb/10/b", 3.0), ("b/2024/mar/01/c", 4.0), ("b/x/y", 2.0)]
    df = spark.createDataFrame(rows, "article_id string, label double")
    p = os.path.join(tmpdir_path, "dated")
    WR.write_dated_labels(df, p)
    got = RD.read_dated_labels(spark, p, "2024-02-01", "2024-02-29")
    assert [r.article_id for r in got.collect()] == ["b/2024/feb/10/b"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert spark.read.parquet(p).count() == 4  # undated label kept (null partition)


def test_run_long_form(spark, tmpdir_path):
    preds = spark.createDataFrame([("zero_shot", "x", 1), ("zero_shot", "y", 2), ("few_shot", "x", 2),
                                   ("few_shot", "y", 2)], "mode string, article_id string, pred int")
    truth = spark.createDataFrame([("x", 2), ("y", 2)], "article_id string, label int")
    p = os.path.join(tmpdir_path, "run")
    WR.write_run_long(preds, truth, p, "m", "t", 32)
    summary, back, tr = RD.read_run_long(spark, p)
    acc = {r.mode: r.accuracy for r in summary.collect()}
    assert acc == {"zero_shot": 0.5, "few_shot": 1.0}
    assert back.count() == 4 and tr.count() == 2
    assert sorted(os.listdir(os.path.join(p, "predictions")))[-2:] == ["mode=few_shot", "mode=zero_shot"]


def test_label_map_lines_matches_whole_file_reader(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "pretty")
    os.makedirs(d)
    entries = [("business/2024/jan/05/a", 1), ('quote"d/2024/feb/01/b', 2.5), ("café/x", 4),
               ("business/2024/jan/05/a", 3)]
    body = "{\n" + ",\n".join(f"  {json.dumps(k)}: {json.dumps(v)}" for k, v in entries) + "\n}\n"
    with open(os.path.join(d, "labels.json"), "w", encoding="utf-8") as f:
        f.write(body)
    lines = {r.article_id: r.label for r in RD.read_label_map_lines(spark, d).collect()}
    whole = {r.article_id: r.label for r in RD.read_label_map(spark, d).collect()}
    assert lines == whole == {"business/2024/jan/05/a": 3.0, 'quote"d/2024/feb/01/b': 2.5, "café/x": 4.0}


def test_label_map_lines_reports_what_it_cannot_read(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "maps")
    os.makedirs(d)
    for name, body in (("good.json", '{\n  "a": 1\n}\n'), ("compact.json", '{"b": 1, "c": 2}'), ("word.json", '{\n  "d": 1,\n  "e": "x"\n}')):
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    assert [r.article_id for r in RD.read_label_map_lines(spark, d).collect()] == ["a"]
    assert {r.src_file: r.bad_lines for r in RD.label_map_line_errors(spark, d).collect()} == {"compact.json": 1, "word.json": 1}


def _pages(spark, tmpdir_path, name, numbers, announced=None):
    d = os.path.join(tmpdir_path, name)
    os.makedirs(d)
    for n in numbers:
        write_json(os.path.join(d, f"page_{n}.json"), {"page": n, "response": {"status": "ok", "pages": announced, "results": [art(f"p{n}")]}})
    return sorted(r.id for r in RD.assemble_pages(RD.read_search_pages(spark, d)).collect())


def test_assemble_pages_stop_rules(spark, tmpdir_path):
    assert _pages(spark, tmpdir_path, "announced", [1, 2, 3], 2) == ["p1", "p2"]
    assert _pages(spark, tmpdir_path, "gap", [1, 2, 4], 9) == ["p1", "p2"]
    assert _pages(spark, tmpdir_path, "late", [2, 3], 9) == []
    assert _pages(spark, tmpdir_path, "all", [1, 2, 3], 9) == ["p1", "p2", "p3"]


@pytest.mark.parametrize("numbers,last", [
    ([5, 5, 3, 5], 3),        # the third page says that it is the last one
    ([2, 3, 3], 3),           # the first page's number has grown since
    ([None, 3, 3], 1),        # a response without a number counts as one page
    ([3, None, 3], 2),
    ([0, 3], 1), ([9, 9], 2), ([3, 1, 1], 2)])
def test_each_response_says_whether_it_is_the_last(spark, numbers, last):
    rows = [(k + 1, ("ok", None, n, k + 1, [(f"p{k + 1}", None, None, None, None, None)])) for k, n in enumerate(numbers)]
    got = RD.assemble_pages(spark.createDataFrame(rows, RD.SEARCH_PAGE))
    assert sorted(r.id for r in got.collect()) == [f"p{k + 1}" for k in range(last)]


def test_a_page_landed_twice_counts_once(spark):
    rows = [(1, ("ok", None, 1, 1, [("a", None, None, None, None, None)])), (1, ("ok", None, 5, 1, [("a", None, None, None, None, None)])),
            (2, ("ok", None, 2, 2, [("b", None, None, None, None, None)])), (0, ("ok", None, 5, 0, [("zero", None, None, None, None, None)]))]
    assert sorted(r.id for r in RD.assemble_pages(spark.createDataFrame(rows, RD.SEARCH_PAGE)).collect()) == ["a", "a", "b"]


def test_snapshot_winner_does_not_sort_bodies(spark, tmpdir_path):
    for k in (1, 2):
        write_json(os.path.join(tmpdir_path, f"s{k}.json"), [art(f"a/{i}") for i in range(5 * k)])
    df = RD.read_article_snapshots(spark, [os.path.join(tmpdir_path, f"s{k}.json") for k in (1, 2)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "SortAggregate" not in plan


def test_staged_folders_are_removed(spark):
    from tidings.session import checkpoint_root, ensure_checkpoint_dir, stage, staging
    with staging(spark):
        n = stage(spark.range(5).toDF("x"), "probe").count()
        path = checkpoint_root(spark, "probe")
        spark.range(1).write.parquet(path)
        here = os.path.dirname(path.removeprefix("file:"))
        assert n == 5 and [x for x in os.listdir(here) if x.startswith("probe")]
    assert not [x for x in os.listdir(here) if x.startswith("probe")] and ensure_checkpoint_dir(spark)


def test_compressed_json_lands_and_is_read_back(spark, tmpdir_path):
    p, q = os.path.join(tmpdir_path, "gz"), os.path.join(tmpdir_path, "plain")
    df = spark.createDataFrame([(1, "x" * 5000), (2, None)], "id int, t string").coalesce(1)
    WR.write_table(df, p, fmt="json", compression="gzip")
    WR.write_table(df, q, fmt="json")
    size = lambda d, end: sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d) if f.endswith(end))
    assert 0 < size(p, ".json.gz") < size(q, ".json") / 10 and size(p, ".json") == 0
    assert sorted(map(tuple, spark.read.schema(df.schema).json(p).collect())) == sorted(map(tuple, df.collect()))


def test_search_pages_are_shuffled_once_and_land_compressed(spark, tmpdir_path, monkeypatch):
    from tidings.plans import catalog as C
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("text "), "id"), 300).alias("text"), F.lit("en").alias("lang"),
                                    F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    roots, plans, write = [], [], WR.write_table
    monkeypatch.setattr(C, "checkpoint_root", lambda s, n, f=C.checkpoint_root: roots.append(f(s, n)) or roots[-1])
    monkeypatch.setattr(WR, "write_table", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **k))
    got = {}
    for r in C.assembled_search_pages(spark, tmpdir_path).collect():
        got.setdefault(r.run, []).append((r.page, r.pos, r.id))
    assert {k: max(p for p, _, _ in v) for k, v in got.items()} == {"error": 10, "gap": 13, "shrinking": 12, "unnumbered": 6}  # of 20 pages
    assert all(sorted((p, k) for p, k, _ in v) == [(p, k) for p in range(1, max(v)[0] + 1) for k in range(50)] for v in got.values())
    assert len(plans) == 4 and not any("collect_list" in p for p in plans)  # none of the four builds the pages anew
    landed = [f for d, _, files in os.walk(roots[0]) for f in files if f.startswith("part-")]
    assert landed and all(f.endswith(".json.gz") for f in landed)
