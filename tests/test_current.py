"""A current table merged from snapshots: right rows, and no untouched bucket read or written."""

import os
import random

import pytest

from tidings.sources import current

SCHEMA = "id string, version int, part string, body string"


def _state(spark, store, schema, **k):
    return {r.id: (r.version, r.part, r.body) for r in current.read_current(spark, store, schema, **k).collect()}


def test_merges_equal_the_latest_rows(spark, tmpdir_path):
    rnd, store, want = random.Random(8), os.path.join(tmpdir_path, "store"), {}
    schema = spark.createDataFrame([], SCHEMA).schema
    assert _state(spark, store, schema) == {}
    for number in range(5):
        rows = [(f"k{rnd.randrange(40)}", rnd.choice([None, 1, 2, 3]), rnd.choice(["a", "b", None]), f"body {number} {i}") for i in range(12)]
        rows += [(None, 9, "z", "no key"), rows[0], rows[0]]
        snapshot = spark.createDataFrame(rows, schema).repartition(3)
        for _ in range(2):
            current.merge(snapshot, store, number, order=["version", "part"], buckets=7)

        def rank(r):
            return (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
        for key in {r[0] for r in rows if r[0]}:
            best = max(rank(r) for r in rows if r[0] == key)
            if key not in want or best >= rank((key, *want[key][0][:2])):
                want[key] = [r[1:] for r in rows if r[0] == key and rank(r) == best]  # of equal rows any
        got = _state(spark, store, schema)
        assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)
        want = {k: [v] for k, v in got.items()}


def test_only_touched_buckets_are_read_and_written(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    first = spark.createDataFrame([(f"k{i}", 1, "p", "x" * 50) for i in range(300)], SCHEMA)
    assert current.merge(first, store, 0, order=["version"], buckets=16) == list(range(16))
    files = {b: [os.stat(os.path.join(store, "gen=0", f"bucket={b}", f)).st_mtime_ns for f in os.listdir(os.path.join(store, "gen=0", f"bucket={b}"))] for b in range(16)}
    second = spark.createDataFrame([("k5", 2, "p", "new"), ("k6", 0, "p", "outdated")], SCHEMA)
    bucket = {r.id: r.b for r in second.select("id", current.bucket_of("id", 16).alias("b")).collect()}
    assert current.merge(second, store, 1, order=["version"], buckets=16) == [bucket["k5"]]
    assert [f for f in os.listdir(os.path.join(store, "gen=1")) if f.startswith("bucket")] == [f"bucket={bucket['k5']}"]
    assert files == {b: [os.stat(os.path.join(store, "gen=0", f"bucket={b}", f)).st_mtime_ns for f in os.listdir(os.path.join(store, "gen=0", f"bucket={b}"))] for b in range(16)}
    old = current.read_current(spark, store, first.schema, buckets=[bucket["k5"]], before=1)
    assert {os.path.basename(os.path.dirname(f)) for f in old.inputFiles()} == {f"bucket={bucket['k5']}"}  # what the merge read
    got = _state(spark, store, first.schema)
    assert len(got) == 300 and got["k5"] == (2, "p", "new") and got["k6"] == (1, "p", "x" * 50)
    assert current.merge(second, store, 2, order=["version"], buckets=16) == [bucket["k5"]]  # equal rows: the snapshot wins
    outdated = spark.createDataFrame([("k7", 0, "p", "outdated")], SCHEMA)
    assert current.merge(outdated, store, 3, order=["version"], buckets=16) == [] and not os.path.exists(os.path.join(store, "gen=3"))


def test_an_unfinished_generation_is_not_read(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    a, b = (spark.createDataFrame([("k", v, "p", f"v{v}")], SCHEMA) for v in (1, 2))
    current.merge(a, store, 0, order=["version"])
    current.merge(b, store, 1, order=["version"])
    os.remove(os.path.join(store, "gen=1", "_SUCCESS"))
    assert _state(spark, store, a.schema)["k"] == (1, "p", "v1")
    current.merge(b, store, 1, order=["version"])
    assert _state(spark, store, a.schema)["k"] == (2, "p", "v2")


def test_label_files_merge_like_the_batch_merge(spark, tmpdir_path):
    from conftest import SF001
    from tidings.operators import labels as L
    from tidings.sources import views as V
    store = os.path.join(tmpdir_path, "store")
    batches = V.label_batches(spark, SF001)
    names = sorted(r[0] for r in batches.select("src_file").distinct().collect())
    for number, lot in enumerate((names[::2], names[1::2])):  # files may arrive in any order
        current.merge(batches.where(batches.src_file.isin(lot)), store, number, key="article_id", order=["src_file", "pos"], buckets=8)
    got = {r.article_id: r.label for r in current.read_current(spark, store, batches.schema).collect()}
    assert got == {r.article_id: r.label for r in L.merge_label_files(batches).collect()}


def test_without_order_the_last_snapshot_wins(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    for k in range(2):
        current.merge(spark.createDataFrame([("a", f"v{k}"), (f"only{k}", "x")], "id string, body string"), store, k)
    schema = spark.createDataFrame([], "id string, body string").schema
    assert {r.id: r.body for r in current.read_current(spark, store, schema).collect()} == {"a": "v1", "only0": "x", "only1": "x"}
