"""Scoring with a pluggable scorer (M5-M7), usage / cost / progress."""

import math

from pyspark.sql import functions as F

from tidings.functions import text
from tidings.operators import scoring as SC
from tidings.operators.lexicon import lexicon_answer, lexicon_factory


def flaky_factory():
    def scorer(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("server error")
        return [str(len(t) % 5) for t in texts]
    return scorer


def test_failures_are_isolated(spark):
    rows = [(str(i), "boom" if i == 3 else "x" * i) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(2)
    out = {r.id: r for r in SC.with_label(SC.score_texts(df, flaky_factory, batch_size=4)).collect()}
    assert out["3"].status == "failed" and "server error" in out["3"].error and out["3"].label is None
    assert all(out[str(i)].status == "ok" for i in range(10) if i != 3)
    assert out["7"].label == 2  # "2"
    dflt = SC.with_label(SC.score_texts(df, flaky_factory), default_on_error=True)
    assert dflt.where(F.col("id") == "3").first().label == 2


def test_batches_are_bounded(spark):
    def sizes_factory():
        def scorer(texts):
            assert len(texts) <= 32
            return [str(len(texts))] * len(texts)
        return scorer
    df = spark.createDataFrame([(str(i), "t") for i in range(100)], "id string, text string").coalesce(1)
    got = [int(r.raw_response) for r in SC.score_texts(df, sizes_factory).collect()]
    assert max(got) == 32 and sorted(set(got)) == [4, 32]


def test_keep_columns_and_resume(spark):
    df = spark.createDataFrame([("a", "gains rally", 7), ("b", "crash", 9)], "id string, text string, n int")
    s = SC.score_texts(df, lexicon_factory, keep=["n"])
    got = {r.id: (r.n, r.raw_response) for r in s.collect()}
    assert got == {"a": (7, "4"), "b": (9, "1")}
    todo = SC.not_yet_scored(df, s.where(F.col("id") == "a"))
    assert [r.id for r in todo.collect()] == ["b"]


def test_lexicon_answer():
    assert lexicon_answer("Strong gains and a rally") == "4"
    assert lexicon_answer("nothing here") == "2"
    assert lexicon_answer("loss") == "1"


def test_usage_and_cost(spark):
    rows = [("a", "ok", 400, "3"), ("b", "ok", 0, "12345678"), ("c", "failed", 100, None)]
    df = spark.createDataFrame(rows, "id string, status string, pt int, raw_response string")
    u = SC.token_usage(df, prompt_tokens="pt")
    r = SC.usage_summary(u).first()
    assert (r.total_api_calls, r.failed_api_calls) == (2, 1)
    assert r.total_input_tokens == 400 and r.total_output_tokens == 2
    assert math.isclose(r.total_cost, 400 * 0.0025 / 1000 + 2 * 0.010 / 1000)
    arts = spark.createDataFrame([(str(i), "x" * (4 * i)) for i in range(1, 8)], "id string, p string")
    full = SC.cost_estimate(arts, F.col("p")).first()
    assert full.num_articles == 7 and full.estimated_input_tokens == sum(range(1, 8))
    assert full.estimated_output_tokens == 210
    samp = SC.cost_estimate(arts, F.col("p"), order_col="id", sample=5).first()
    assert samp.estimated_input_tokens == int(3.0 * 7)
    empty = SC.cost_estimate(arts.limit(0), F.col("p")).first()
    assert empty.num_articles == 0 and empty.estimated_total_cost == 0.0


def test_batch_progress(spark):
    rows = [(i, "failed" if i == 5 else "ok") for i in range(12)]
    df = spark.createDataFrame(rows, "idx long, status string")
    got = {r.batch: (r.rows, r.failed_rows, r.batch_ok) for r in SC.batch_progress(df, "idx", 5).collect()}
    assert got == {0: (5, 0, True), 1: (5, 1, False), 2: (2, 0, True)}


def test_messages(spark):
    df = spark.createDataFrame([("a", "A text", 0)], "id string, text string, label int")
    m = df.select(SC.zero_shot_messages("text").alias("m")).first().m
    assert [x.role for x in m] == ["system", "user"] and m[1].content == "Article:\nA text"
    ex = spark.createDataFrame([("e3", 3), ("e1", 1)], "text string, label int")
    few = SC.few_shot_messages(df, ex).first().messages
    assert [x.role for x in few] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert few[1].content == "Article:\ne1" and few[2].content == "1" and few[4].content == "3"


def test_prompt_token_estimate(spark):
    df = spark.createDataFrame([("T", None, "b")], "webTitle string, standfirst string, bodyText string")
    p = df.select(text.sectioned_prompt().alias("p")).first().p
    assert p.startswith("Analyze the following article") and "Excerpt: b" in p and "Summary:" not in p


def test_polarity_scoring_skips_blank(spark):
    from tidings.operators.lexicon import lexicon_polarity_factory
    rows = [("a", "gains rally gains"), ("b", "   "), ("c", "loss"), ("d", "nothing"), ("e", "gains loss loss")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: (r.status, r.label) for r in SC.score_polarity(df, lexicon_polarity_factory).collect()}
    assert got["b"] == ("skipped", 2)
    assert got["a"] == ("ok", 4) and got["c"] == ("ok", 0) and got["d"] == ("ok", 2)
    assert got["e"] == ("ok", 1)  # negative, confidence 2/3 <= 0.75


def test_compare_predictors(spark):
    from tidings.plans.pipelines import compare_predictors
    rows = [("a", "1", 1, 1), ("a", "2", 2, 3), ("b", "1", 1, 1), ("b", "2", 2, 2), ("b", "3", 0, 4)]
    p = spark.createDataFrame(rows, "model string, article_id string, y_true int, y_pred int")
    r = compare_predictors(p, "a", "b")
    s = {x.model: x for x in r["summary"].collect()}
    assert s["b"].n == 2 and s["a"].accuracy == 0.5  # aligned on the common ids only
    assert r["agreement"].first().agreement == 0.5


def test_spread_rebalances_scoring(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("gains").alias("text")).coalesce(1)
    s = SC.score_texts(df, lexicon_factory, spread=4)
    assert s.rdd.getNumPartitions() == 4 and s.count() == 200
