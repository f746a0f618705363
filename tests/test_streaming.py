"""Structured Streaming: T2 equals the batch aggregate; T1 resumes by id."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from tidings.operators.lexicon import lexicon_factory
from tidings.streaming import daily
from tidings.streaming.labelling import run_labelling_stream


def test_daily_stream_equals_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    streamed = daily.stream_daily_from_table(ev, "ts", "value", ["event_type"])
    batch = daily.daily_batch(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    key = ["date", "event_type"]
    a = {tuple(r[k] for k in key): (r.n_articles, round(r.sentiment, 9)) for r in streamed.collect()}
    b = {tuple(r[k] for k in key): (r.n_articles, round(r.sentiment, 9)) for r in batch.collect()}
    assert a == b and len({k[0] for k in a}) == 30


def test_daily_stream_restart_does_not_double_count(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    landing, out, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "out", "ck"))
    first = ev.where(F.col("ts") < "2024-01-15")
    daily.land_with_sentinel(first, landing, "ts", sentinel_ts="2024-01-16 00:00:00")
    schema = spark.read.parquet(landing).schema
    daily.run_daily_stream(spark, landing, schema, out, ck)
    n1 = spark.read.parquet(out).count()
    daily.land_with_sentinel(ev.where(F.col("ts") >= "2024-01-15"), landing, "ts")
    daily.run_daily_stream(spark, landing, schema, out, ck)  # restart from the checkpoint
    res = spark.read.parquet(out)
    assert n1 == 14 and res.count() == 30
    assert res.agg(F.sum("n_articles")).first()[0] == ev.count()


def test_incremental_labelling_resumes_by_id(spark, tmpdir_path):
    rows = [(f"a/{i}", "article" if i % 5 else "liveblog", f"title {i}", "gains" if i % 2 else "loss")
            for i in range(40)]
    df = spark.createDataFrame(rows, "id string, type string, webTitle string, bodyText string")
    landing, results, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "results", "ck"))
    df.where(F.col("id") < "a/2").write.mode("append").parquet(landing)
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=df.schema)
    n1 = spark.read.parquet(results).count()
    df.write.mode("append").parquet(landing)  # re-sends the first wave too
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=df.schema)
    r = spark.read.parquet(results)
    assert 0 < n1 < r.count()
    assert r.count() == r.select("id").distinct().count() == 32  # 40 minus 8 liveblogs


class _Storage(Exception):
    pass


def _boom_once_factory(flag):
    def factory():
        def scorer(texts):
            if os.path.exists(flag) and any("title 3" in t for t in texts):
                raise RuntimeError("no answer")
            return ["3"] * len(texts)
        return scorer
    return factory


def test_failed_rows_are_retried_and_latest_wins(spark, tmpdir_path):
    from tidings.streaming.labelling import latest_labels, retry_failed
    landing, results, ck, flag = (os.path.join(tmpdir_path, x) for x in ("landing", "results", "ck", "flag"))
    open(flag, "w").close()
    df = spark.createDataFrame([(f"a/{i}", None, f"title {i}", "x") for i in range(6)], "id string, type string, webTitle string, bodyText string")
    df.write.parquet(landing)
    factory = _boom_once_factory(flag)
    run_labelling_stream(spark, landing, results, ck, factory, schema=df.schema)
    assert {r.id: r.status for r in latest_labels(spark, results).collect()} == {f"a/{i}": "failed" if i == 3 else "ok" for i in range(6)}
    os.rename(flag, flag + "-off")
    assert retry_failed(spark, df, results, factory) == 1
    got = {r.id: (r.status, r.label) for r in latest_labels(spark, results).collect()}
    assert got == {f"a/{i}": ("ok", 3) for i in range(6)}


def test_a_crashed_batch_is_replaced_not_doubled(spark, tmpdir_path):
    import pytest
    from tidings.streaming import labelling
    landing, results, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "results", "ck"))
    df = spark.createDataFrame([(f"a/{i}", None, "t", "gains") for i in range(8)], "id string, type string, webTitle string, bodyText string")
    df.write.parquet(landing)
    real = labelling._write

    def write_and_crash(*args):
        real(*args)
        raise _Storage("lost after the write")

    labelling._write = write_and_crash
    try:
        with pytest.raises(Exception, match="lost after the write"):
            run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=df.schema)
    finally:
        labelling._write = real
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=df.schema)
    rows = labelling.results_table(spark, results)
    assert rows.count() == 8 and rows.select("id").distinct().count() == 8
    assert labelling.results_table(spark, os.path.join(tmpdir_path, "none")) is None


def test_labelling_stream_reads_json_array_snapshots(spark, tmpdir_path):
    import json
    landing, results, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "results", "ck"))
    os.makedirs(landing)
    for k in range(2):
        arts = [{"id": f"a/{k}/{i}", "type": "article", "webTitle": "t", "fields": {"bodyText": "gains"}}
                for i in range(5)] + [{"id": f"lb/{k}", "type": "liveblog"}]
        with open(os.path.join(landing, f"articles_{k}.json"), "w") as f:
            json.dump(arts, f)
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, fmt="json")
    r = spark.read.parquet(results)
    assert r.count() == 10 and r.where(F.col("status") == "ok").count() == 10
    assert {x.id for x in r.collect()} == {f"a/{k}/{i}" for k in range(2) for i in range(5)}
