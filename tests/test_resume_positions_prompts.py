"""Resume over bucketed tables (M7), the position index (W6, F7), shared prompts (P11, M8), batches by length (M5)."""

import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.operators import metrics as M
from tidings.operators import profile as PR
from tidings.operators import scoring as SC
from tidings.operators.lexicon import lexicon_answer, lexicon_factory, lexicon_scorer
from tidings.plans import pipelines as PL
from tidings.sources import positions
from tidings.sources import writers as WR


def test_resume_of_bucketed_tables_moves_no_rows(spark, tmpdir_path):
    arts = spark.createDataFrame([(f"a{i}", "article" if i % 5 else "liveblog", f"gains {i}", "loss" * (i % 3)) for i in range(200)],
                                 "id string, type string, webTitle string, bodyText string")
    done = spark.createDataFrame([(f"a{i}", "ok" if i % 7 else "failed", 2) for i in range(0, 150)], "id string, status string, label int")
    WR.write_bucketed(arts, "resume_articles", os.path.join(tmpdir_path, "a"), key="id", buckets=8)
    WR.write_bucketed(done, "resume_results", os.path.join(tmpdir_path, "r"), key="id", buckets=8)
    todo = SC.not_yet_scored(PR.drop_liveblogs(spark.table("resume_articles")), spark.table("resume_results"), join_hint="merge")
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = {f"a{i}" for i in range(200) if i % 5 and (i >= 150 or i % 7 == 0)}
    assert {r.id for r in todo.collect()} == want
    run = PL.labelling_run(spark.table("resume_articles"), lexicon_factory, previous=spark.table("resume_results"), join_hint="merge")
    assert {r.id for r in run.collect()} == want and "Exchange" not in run._jdf.queryExecution().executedPlan().toString()


# --- positions ---

def test_positions_without_a_sort(spark, tmpdir_path):
    path, index = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "i")
    order = list(range(1000))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(k, f"row {k}") for k in order], "k long, body string").repartition(6)
    WR.write_in_order(df, path, ["k"], files=8)
    positions.build_index(spark, path, index)
    assert spark.read.parquet(index).count() > 3
    whole = positions.with_position(spark, path, index)
    assert [(r.k, r.idx) for r in whole.orderBy("k").collect()] == [(k, k) for k in range(1000)] and whole.columns == ["k", "body", "idx"]
    for start, count in ((0, 1), (100, 50), (990, 50), (-5, 3), (2000, 5), (5, 0), (0, 1000)):
        got = positions.read_positions(spark, path, index, start, count)
        first = max(0, start)
        assert sorted((r.k, r.idx) for r in got.collect()) == [(k, k) for k in range(first, min(1000, first + max(0, count)))]
    some = positions.read_positions(spark, path, index, 100, 50)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(some.inputFiles()) <= 2 < len(files)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_positions_of_an_empty_table(spark, tmpdir_path):
    path, index = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "i")
    WR.write_in_order(spark.createDataFrame([], "k long"), path, ["k"])
    positions.build_index(spark, path, index)
    assert positions.with_position(spark, path, index).count() == 0 and positions.read_positions(spark, path, index, 0, 5).columns == ["k", "idx"]
    assert positions.read_positions(spark, path, index, 0, 5).count() == 0


# --- shared prompts ---

def test_conversations_by_reference_equal_whole_ones(spark):
    d = spark.createDataFrame([(f"a{i}", f"text {i % 6}", i % 3) for i in range(20)], "id string, text string, label int")
    ex, rest = d.where("id IN ('a0', 'a1', 'a2')"), d.where("id NOT IN ('a0', 'a1', 'a2')")
    prefix = SC.shared_prefix(ex)
    assert prefix.count() == 7 and prefix.select("prefix_id").distinct().count() == 1
    store = SC.message_store(rest, prefix)
    refs = SC.conversation_references(rest, prefix)
    content = {r.message_id: (r.role, r.content) for r in store.collect()}
    assert store.count() == len(content)
    head = [content[r.message_id] for r in prefix.orderBy("position").collect()]
    built = {r.id: [*head, content[r.message_id]] for r in refs.collect()}
    whole = {r.id: [(m.role, m.content) for m in r.messages] for r in SC.few_shot_messages(rest, ex).collect()}
    assert built == whole
    longest = max(len(str(r)) for r in refs.collect())
    assert longest < 200  # no text in a row
    none = SC.shared_prefix(ex.limit(0))
    assert [r.role for r in none.collect()] == ["system"]


@given(st.text(alphabet="aGgainsloss. \nÉ", max_size=30), st.lists(st.text(alphabet="aGgainsloss. \nÉ", max_size=20), max_size=4))
def test_a_prefix_read_once_gives_the_same_answers(prefix, texts):
    assert lexicon_scorer.with_prefix(prefix)(texts) == [lexicon_answer(prefix + t) for t in texts]


def test_prefixes_of_any_scorer(spark):
    def plain():
        def scorer(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no")
            return [str(len(t)) for t in texts]
        return scorer
    df = spark.createDataFrame([(str(i), "m" if i % 2 else "n", "boom" if i == 3 else "x" * (i % 9)) for i in range(50)], "id string, mode string, text string")
    out = SC.score_texts(df, plain, keep=["mode"], prefixes={"m": "12345", "n": ""}, prefix_col="mode", batch_size=4)
    for r in out.collect():
        i = int(r.id)
        assert (r.status, r.raw_response) == (("failed", None) if i == 3 else ("ok", str(i % 9 + 5 * (i % 2))))


# --- batches by length ---

def test_answers_are_the_same_and_batches_hold_less_padding(spark):
    def padded():
        def scorer(texts):
            widest = max(map(len, texts))
            return [f"{len(t)}:{widest - len(t)}" for t in texts]
        return scorer
    rnd = random.Random(9)
    rows = [(str(i), "x" * int(rnd.paretovariate(0.8) * 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, text string").coalesce(2)
    a, b = ({r.id: r.raw_response.split(":") for r in SC.score_texts(df, padded, by_length=x).collect()} for x in (True, False))
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} == {i: str(len(t)) for i, t in rows}
    wasted = [sum(int(v[1]) for v in x.values()) for x in (a, b)]
    assert wasted[0] < wasted[1] / 3


def test_batch_order_is_stable():
    assert SC.batch_order(["bb", "a", "cc", "", "d"]) == [3, 1, 4, 0, 2]


def test_confusion_matrix_of_groups_without_listed_classes(spark):
    p = spark.createDataFrame([("m", 0, 4), ("m", 0, 4), ("m", 7, 0), ("m", 2, -1), ("n", 9, 9), ("m", None, 1)], "model string, y_true int, y_pred int")
    got = {(r.model, r.y_true, r.y_pred): r.n for r in M.confusion_matrix(p).collect()}
    assert len(got) == 50 and got[("m", 0, 4)] == 2 and sum(got.values()) == 2
    assert M.confusion_matrix(p.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["chat_prompts"])
def test_no_example_text_in_the_rows_of_the_query(spark, name):
    from conftest import SF001
    from tidings.plans.catalog import QUERIES
    assert QUERIES[name](spark, SF001).agg(F.max(F.length("content_md5"))).first()[0] == 33 * 12 - 1
