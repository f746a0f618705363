"""User-level pipelines E1-E5 on small literal inputs."""

import datetime as dt

from pyspark.sql import functions as F

from tidings.operators.lexicon import lexicon_factory
from tidings.plans import pipelines as PL


def _labels(spark):
    rows = [("business/2024/jan/0%d/x%d" % (d, i), float((d + i) % 5)) for d in range(1, 10) for i in range(3)]
    rows += [("business/article/2024/jan/05/y", 4.0)]
    return spark.createDataFrame(rows, "article_id string, label double")


def test_sentiment_market_report(spark):
    prices = spark.createDataFrame(
        [("SPY", dt.datetime(2024, 1, d, 21), 100.0 + d * (d % 3)) for d in range(1, 12)],
        "symbol string, ts timestamp, close double")
    rep = PL.sentiment_market_report(_labels(spark), prices)
    comb = rep.combined.orderBy("date").collect()
    assert len(comb) == 9 and comb[0]["return"] is None and comb[1]["return"] is not None
    st = rep.stats.first()
    assert st.n_days == 9 and st.dir_days <= 8
    lags = {r.lag: r["corr"] for r in rep.lags.collect()}
    assert set(lags) == {0, 1, 2, 3, 4, 5} and lags[0] == st["corr"]
    lenient = PL.sentiment_market_report(_labels(spark), prices, lenient=True)
    assert lenient.combined.agg(F.sum("n_articles")).first()[0] == 28


def test_build_consensus_labels(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], "article_id string, label double")
    b = spark.createDataFrame([("1", 2.0), ("2", 2.0), ("4", 0.0)], "article_id string, label double")
    c = PL.build_consensus_labels(a, b)
    got = {r.article_id: r.label for r in c.labels.collect()}
    assert got == {"1": 2.0, "2": 2.0, "3": 3.0, "4": 0.0}
    ag = c.agreement.first()
    assert (ag.both, ag.only_a, ag.only_b) == (2, 1, 1)
    dist = {r["label"]: r["count"] for r in c.distribution.collect()}
    assert dist == {0: 1, 1: 0, 2: 2, 3: 1, 4: 0}


def test_range_dashboard(spark):
    daily, rng, kpis = PL.range_dashboard(_labels(spark))
    r = rng.first()
    assert r.min_date == dt.date(2024, 1, 1) and r.max_date == dt.date(2024, 1, 9)
    k = kpis.first()
    assert k.n_days == 9 and k.n_articles == 27
    k2 = PL.range_dashboard(_labels(spark), "2024-01-02", "2024-01-03")[2].first()
    assert k2.n_days == 2 and k2.n_articles == 6


def test_article_profile_and_labelling_run(spark):
    rows = [("a/%d" % i, "liveblog" if i == 0 else "article", "T%d" % i, None, "gains" if i % 2 else "crash",
             "2024-01-0%dT00:00:00Z" % (i + 1)) for i in range(6)]
    arts = spark.createDataFrame(rows, "id string, type string, webTitle string, standfirst string, "
                                       "bodyText string, webPublicationDate string")
    counts, stats = PL.article_profile(arts)
    assert {r.type: r["count"] for r in counts.collect()} == {"liveblog": 1, "article": 5}
    assert {r.type for r in stats.collect()} == {"liveblog", "article", "all"}
    run = PL.labelling_run(arts, lexicon_factory)
    out = {r.id: r for r in run.collect()}
    assert len(out) == 5 and all(r.status == "ok" and r.prompt_tokens > 0 for r in out.values())
    again = PL.labelling_run(arts, lexicon_factory, previous=run.select("id", "status"))
    assert again.count() == 0


def test_baseline_run(spark):
    from tidings.operators.lexicon import lexicon_polarity_factory
    words = {0: "crash loss fears slump", 4: "gains rally record profit"}
    rows = [(f"a{k}-{i}", words[k] + f" filler{i % 7}", k) for k in words for i in range(60)]
    ds = spark.createDataFrame(rows, "id string, text string, label int")
    out = {r.model: r for r in PL.baseline_run(ds, lexicon_polarity_factory, max_iter=30).collect()}
    assert set(out) == {"logistic_regression", "polarity"}
    assert out["logistic_regression"].n == out["polarity"].n > 0
    assert out["logistic_regression"].accuracy > 0.9 and out["polarity"].accuracy == 1.0


def test_evaluate_prompting_excludes_examples(spark):
    from tidings.operators import learn as LE
    rows = [(f"a{i}", "article", f"T{i}", ("gains " if i % 2 else "crash ") + f"text {i}", i % 5) for i in range(60)]
    ds = spark.createDataFrame(rows, "id string, type string, webTitle string, text string, label int")
    preds, summary = PL.evaluate_prompting(ds, lexicon_factory)
    ex_ids = {r.id for r in LE.few_shot_examples(ds).collect()}
    got = preds.collect()
    assert len(ex_ids) == 5
    assert not ex_ids & {r.id for r in got}                       # few-shot ∩ eval = ∅
    assert {r.mode for r in got} == {"zero_shot", "few_shot"}
    per_mode = {r.mode: r.n for r in summary.collect()}
    assert per_mode == {"zero_shot": 55, "few_shot": 55}


def test_baselines_build_their_dataset_once(spark, monkeypatch):
    from tidings.operators.lexicon import lexicon_polarity_factory
    words = ["gains rally rise", "loss crash fall"]
    texts = spark.createDataFrame([(f"a{i}", f"{words[i % 2]} noise{i % 7}") for i in range(200)], "id string, text string")
    built = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            built.add(len(p))
            yield p
    labels = spark.createDataFrame([(f"a{i}", 4.0 if i % 2 == 0 else 0.0) for i in range(200)], "id string, label double")
    data = texts.mapInPandas(counted, "id string, text string").join(labels, "id")
    out = {r.model: r for r in PL.baseline_run(data, lexicon_polarity_factory, max_iter=20).collect()}
    assert built.value == 200
    assert out["logistic_regression"].n == out["polarity"].n > 0
    assert out["logistic_regression"].accuracy == out["polarity"].accuracy == 1.0
