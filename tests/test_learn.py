"""Splits, weights, few-shot picks and the TF-IDF + logistic-regression model."""

import math

import pytest
from pyspark.sql import functions as F

from tidings.operators import learn as LE


def test_hash_split_disjoint_complete_stable(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"))
    a = LE.hash_split(df)
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(counts.values()) == 20000
    assert abs(counts["train"] / 20000 - 0.70) < 0.02 and abs(counts["test"] / 20000 - 0.15) < 0.02
    b = LE.hash_split(df.repartition(7))
    assert a.join(b.withColumnRenamed("split", "s2"), "id").where(F.col("split") != F.col("s2")).count() == 0


def test_stratified_split_per_class(spark):
    df = spark.range(30000).select(F.col("id").cast("string").alias("id"),
                                   F.when(F.col("id") % 10 < 6, 2).otherwise(F.col("id") % 5).alias("label"))
    s = LE.stratified_split(df, exact=False, method="xxhash64")
    assert s.count() == 30000
    per = s.groupBy("label").agg(F.avg((F.col("split") == "test").cast("double")).alias("t"),
                                 F.avg((F.col("split") == "val").cast("double")).alias("v")).collect()
    for r in per:
        assert abs(r.t - 0.15) < 0.01 and abs(r.v - 0.15) < 0.01


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    w = {r.label: r.weight for r in LE.balanced_class_weights(df).collect()}
    assert math.isclose(w[0], 4 / (2 * 3)) and math.isclose(w[1], 4 / (2 * 1))


def test_few_shot_examples(spark):
    rows = [(f"id{i}", i % 3, "liveblog" if i % 4 == 0 else "article", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, label int, type string, text string")
    ex = LE.few_shot_examples(df)
    got = ex.collect()
    assert sorted(r.label for r in got) == [0, 1, 2]
    assert all(r.type != "liveblog" for r in got)
    again = LE.few_shot_examples(df.repartition(5)).collect()
    assert sorted((r.label, r.id) for r in got) == sorted((r.label, r.id) for r in again)


def test_smooth_idf_matches_formula(spark):
    df = spark.createDataFrame([("d1", "apple banana apple"), ("d2", "banana cherry")], "id string, text string")
    feats = LE.fit_tfidf(df, stop_words=[])
    row = {r.id: r.features for r in feats.transform(df).collect()}
    assert feats.vocabulary == ["apple", "banana", "cherry"] and feats.doc_freq == [1, 2, 1] and feats.n_docs == 2
    idf = {"apple": math.log((1 + 2) / (1 + 1)) + 1, "banana": math.log((1 + 2) / (1 + 2)) + 1}
    assert all(math.isclose(a, b) for a, b in zip(feats.idf(), [idf["apple"], idf["banana"], idf["apple"]]))
    v = [2 * idf["apple"], idf["banana"], 0.0]
    norm = math.sqrt(sum(x * x for x in v))
    assert type(row["d1"]).__name__ == "SparseVector" and list(row["d1"].indices) == [0, 1]
    assert all(math.isclose(a, b / norm, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(row["d1"].toArray(), v))


def test_vocabulary_is_cut_by_count_then_term(spark):
    df = spark.createDataFrame([("1", "bb bb aa cc dd dd x the"), ("2", "aa cc zz"), ("3", None), ("4", "")], "id string, text string")
    for parts in (1, 5):
        feats = LE.fit_tfidf(df.repartition(parts), vocab_size=3, stop_words=["the", "dd"])
        assert feats.vocabulary == ["aa", "bb", "cc"] and feats.doc_freq == [2, 1, 2] and feats.n_docs == 4
    got = {r.id: r.e for r in feats.transform(df).select("id", LE.sparse_entries().alias("e")).collect()}
    assert [e.position for e in got["1"]] == [0, 1, 2] and [e.position for e in got["2"]] == [0, 2] and got["3"] == got["4"] == []
    assert math.isclose(sum(e.value ** 2 for e in got["1"]), 1.0)
    assert [tuple(r)[:3] for r in feats.terms(spark).orderBy("position").collect()] == [("aa", 0, 2), ("bb", 1, 1), ("cc", 2, 2)]
    with pytest.raises(ValueError, match="no terms"):
        LE.fit_tfidf(df.where("id = '3'"))


def test_stop_words_from_a_file(tmp_path):
    (tmp_path / "stop.txt").write_text("the\n\n# a comment\nof  # why\n and\n", encoding="utf-8")
    assert LE.read_stop_words(str(tmp_path / "stop.txt")) == ["the", "of", "and"]


def test_logistic_regression_learns_language(spark):
    words = {0: "der die das und nicht", 1: "the and of to with", 2: "le la les et des"}
    rows = [(f"{k}-{i}", " ".join(words[k].split()[j % 5] for j in range(i, i + 6)), k)
            for k in words for i in range(30)]
    df = spark.createDataFrame(rows, "id string, text string, label int")
    feats, model = LE.fit_logistic(df, max_iter=50)
    pred = LE.predict(feats, model, df)
    acc = pred.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
    assert acc > 0.9


def test_select_by_mae_and_text_dataset(spark):
    from tidings.operators import profile as PR
    arts = spark.createDataFrame(
        [(f"a{i}", f"h{i}", None, ("gains rally " if i % 2 else "loss crash ") * 3) for i in range(40)]
        + [("blank", " ", "", "  ")],
        "id string, headline string, standfirst string, bodyText string")
    labels = spark.createDataFrame([(f"a{i}", 4.0 if i % 2 else 0.5) for i in range(40)] + [("blank", 2.0)],
                                   "article_id string, label double")
    d = PR.text_dataset(arts, labels)
    assert d.count() == 40 and d.where(F.col("label") == 0).count() == 20
    assert d.where(F.col("id") == "a1").first().text == "h1  gains rally gains rally gains rally"
    best, feats, model, scores = LE.select_by_mae(d, d, [0.01, 10.0], max_iter=20)
    assert set(scores) == {0.01, 10.0} and scores[best] == min(scores.values())


def _labelled_texts(spark, n=60):
    words = ["gains rally rise", "loss crash fall", "flat same quiet"]
    rows = [(f"a{i}", " ".join((words[i % 3] + " noise" + str(i % 7)).split()[: 2 + i % 3]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id string, text string, label int")


def test_settings_are_searched_side_by_side_like_one_by_one(spark):
    d = _labelled_texts(spark)
    train, val = d.where("id < 'a4'"), d.where("id >= 'a4'")
    grid = LE.reg_grid([10.0, 1.0, 0.1, 1e-3])
    side = LE.search_by_mae(train, val, grid, max_iter=50, parallelism=4)
    one = LE.search_by_mae(train, val, grid, max_iter=50, parallelism=1)
    serial = []
    feats, rows = LE.fit_features(train)
    for reg in (10.0, 1.0, 0.1, 1e-3):
        m = LE.fit_classifier(rows, max_iter=50, reg_param=reg)
        serial.append(LE.predict(feats, m, val).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0])
    assert side[3] == one[3] and all(math.isclose(a, b) for a, b in zip(side[3], serial))
    assert side[0] == one[0] == min(range(4), key=lambda k: (serial[k], k))


def test_certificate_of_an_optimal_and_of_an_unfinished_model(spark):
    feats, rows = LE.fit_features(_labelled_texts(spark))
    done, early = LE.fit_classifier(rows), LE.fit_classifier(rows, max_iter=2)
    a, b = LE.optimality(done, rows).first(), LE.optimality(early, rows).first()
    assert (a.n_rows, a.n_classes, a.n_terms) == (60, 3, len(feats.vocabulary))
    assert a.residual < 1e-4 < b.residual and a.residual < 0.01 * a.residual_at_zero and b.residual > 0.01 * b.residual_at_zero and a.objective < b.objective and b.iterations == 2
    assert math.isclose(a.objective, done.summary.objectiveHistory[-1], rel_tol=1e-6)
    # against plain Python: the gradient by finite differences of the objective
    data = [(r.features.toArray(), int(r.label), r.weight) for r in rows.collect()]
    beta, bias, reg = early.coefficientMatrix.toArray(), early.interceptVector.toArray(), 1 / 60

    def objective(m, c):
        loss = total = 0.0
        for x, y, w in data:
            z = m @ x + c
            loss += w * (math.log(sum(math.exp(v) for v in z)) - z[y])
            total += w
        return loss / total + reg / 2 * float((m ** 2).sum())

    steepest = 0.0
    for i in range(3):
        for j in range(beta.shape[1] + 1):
            m, c = beta.copy(), bias.copy()
            up, down = [], []
            for e, out in ((1e-5, up), (-1e-5, down)):
                m, c = beta.copy(), bias.copy()
                if j < beta.shape[1]:
                    m[i, j] += e
                else:
                    c[i] += e
                out.append(objective(m, c))
            steepest = max(steepest, abs(up[0] - down[0]) / 2e-5)
    assert math.isclose(steepest, b.residual, rel_tol=1e-3)


def test_fit_rows_are_dealt_evenly_whatever_their_classes(spark, monkeypatch):
    rows = [(f"a{i}", f"word{i % 11} noise{i % 7}", 0 if i < 900 else 1 if i < 999 else None) for i in range(1000)]
    d = spark.createDataFrame(rows, "id string, text string, label int").repartition(3)
    monkeypatch.setattr(LE, "FIT_ROWS", (100, 100))
    _, dealt = LE.fit_features(d)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110
    weights = {r.label: r.weight for r in dealt.select("label", "weight").distinct().collect()}
    assert weights == {r.label: r.weight for r in LE.balanced_class_weights(d).where("label IS NOT NULL").collect()} | {None: None}
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(LE, "FIT_ROWS", (1_000, 100_000))
    assert [LE.fit_partitions(spark, n) for n in (0, 1, 999, 1000 * cores, 50_000 * cores, 200_000 * cores)] == [1, 1, 1, cores, cores, 2 * cores]


def test_weights_do_not_shuffle_the_rows_by_class(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("int").alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large rows
    try:
        plan = LE.with_class_weights(d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_exact_stratified_split_counts(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"),
                                   F.when(F.col("id") % 10 < 6, 2).otherwise(F.col("id") % 5).alias("label"))
    s = LE.stratified_split(df)
    assert s.count() == 20000
    got = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    for label, n in sizes.items():
        n_test = math.ceil(0.15 * n)
        n_val = math.ceil(0.1765 * (n - n_test))
        assert got[(label, "test")] == n_test and got[(label, "val")] == n_val
        assert got[(label, "train")] == n - n_test - n_val


def test_grouped_row_index(spark):
    from tidings.operators import profile as PR
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 3000).alias("k"))
    idx = PR.with_row_index(df, "k", group_cols=["g"]).collect()
    for g in range(3):
        rows = sorted((r.k, r.idx) for r in idx if r.g == g)
        assert [i for _, i in rows] == list(range(len(rows)))


def test_row_index_over_several_keys_nulls_and_a_hot_value(spark):
    from tidings.operators import profile as PR
    rows = [(None if i % 50 == 0 else "hot" if i % 2 else f"f{i % 7}", i * 7919 % 4000) for i in range(4000)]
    df = spark.createDataFrame(rows, "file string, pos long")
    got = PR.with_row_index(df, ["file", "pos"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.file, r.pos) for r in sorted(got, key=lambda r: r.idx)] == want
    assert PR.with_row_index(df.limit(0), ["file", "pos"]).count() == 0


def test_few_shot_ties_and_term_statistics(spark):
    df = spark.createDataFrame([("b", 0, "One two"), ("a", 0, "one"), ("c", 1, None)], "id string, label int, text string")
    assert {r.label for r in LE.few_shot_examples(df).collect()} == {0, 1}
    got = {r.term: (r.df, r.idf) for r in LE.term_statistics(df).collect()}
    assert got["one"] == (2, math.log(4 / 3) + 1) and got["two"][0] == 1 and len(got) == 2


def test_term_statistics_agree_with_the_fitted_idf(spark):
    df = spark.createDataFrame([("1", "apple banana apple"), ("2", "Banana cherry")], "id string, text string")
    idf = {r.term: r.idf for r in LE.fit_tfidf(df, stop_words=[]).terms(spark).collect()}
    for r in LE.term_statistics(df).collect():
        assert math.isclose(r.idf, idf[r.term])
