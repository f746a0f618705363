"""Splits, features and classifiers (M1-M4, M11, A27, W5) on ``pyspark.ml``.

Splits are hash-based (md5 of the id and a seed), so a row's side
never depends on partitioning or task order and a lost executor recomputes
the same split. Stratification ranks that hash within each class by ranges (or by
approximate quantiles), not by a per-class ``row_number`` window that would
pull the largest class into one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.session import ensure_checkpoint_dir

SEED = 42


def id_hash(id_col: str, seed: int = SEED, method: str = "md5") -> Column:
    """A seeded, deterministic hash of the id: ``md5`` (default, first 32 bits of
    ``md5("<seed>:<id>")``), which any SQL engine can recompute, so a split
    or pick made on Spark can be reproduced outside it; or ``xxhash64``, which is faster."""
    idc = F.col(id_col).cast("string")
    if method == "md5":
        hexs = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), idc)), 1, 8)
        return F.conv(hexs, 16, 10).cast("long")
    return F.xxhash64(idc, F.lit(seed))


def hash_unit(id_col: str, seed: int = SEED, method: str = "md5") -> Column:
    """Deterministic uniform value in [0, 1) per id, at the hash's full resolution
    (32 bits of md5; the upper 53 bits of xxhash64, which a double holds)."""
    h = id_hash(id_col, seed, method)
    if method == "md5":
        return h / F.lit(float(1 << 32))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def hash_split(df: DataFrame, id_col: str = "id", seed: int = SEED,
               first_holdout: float = 0.3, second_share: float = 0.5, method: str = "md5") -> DataFrame:
    """M1: 70/15/15 like two chained random splits (hold out 30 %, then split
    the holdout in half). Adds ``split`` in {train, val, test}."""
    u = hash_unit(id_col, seed, method)
    train_cut = 1.0 - first_holdout
    val_cut = train_cut + first_holdout * second_share
    return df.withColumn("split", F.when(u < train_cut, "train").when(u < val_cut, "val").otherwise("test"))


def stratified_split(df: DataFrame, label_col: str = "label", id_col: str = "id", seed: int = SEED,
                     test: float = 0.15, val_of_rest: float = 0.1765, accuracy: int = 100000,
                     method: str = "md5", exact: bool = True) -> DataFrame:
    """M2: per-class test share ``test``, then ``val_of_rest`` of the remainder
    (0.15 / 0.1765 gives 70/15/15), rows ordered within a class by the
    seeded id hash.

    ``exact=False``: thresholds are per-class approximate quantiles of the
    hash (``percentile_approx``, one partial aggregate) joined back by class.
    ``exact=True``: exact per-class counts, ``ceil(test * n_c)`` test rows and
    ``ceil(val_of_rest * rest)`` validation rows, from a per-class row
    position computed by :func:`tidings.operators.profile.with_row_index`
    (ranges within each class - no task ever holds a whole class).
    """
    if exact:
        from tidings.operators.profile import with_row_index
        d = df.withColumn("_h", id_hash(id_col, seed, method))
        d = with_row_index(d, ["_h", id_col], "_rank", group_cols=[label_col])
        n = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
        d = d.join(n, label_col, "left")
        n_test = F.ceil(F.lit(test) * F.col("_n"))
        n_val = F.ceil(F.lit(val_of_rest) * (F.col("_n") - n_test))
        split = (F.when(F.col("_rank") < n_test, "test")
                  .when(F.col("_rank") < n_test + n_val, "val").otherwise("train"))
        return d.withColumn("split", split).drop("_h", "_rank", "_n")
    u = hash_unit(id_col, seed, method)
    val_q = test + (1.0 - test) * val_of_rest
    d = df.withColumn("_u", u)
    th = d.groupBy(label_col).agg(F.percentile_approx("_u", [test, val_q], accuracy).alias("_q"))
    j = d.join(th, label_col, "left")
    split = (F.when(F.col("_u") < F.col("_q")[0], "test")
              .when(F.col("_u") < F.col("_q")[1], "val").otherwise("train"))
    return j.withColumn("split", split).drop("_u", "_q")


def balanced_class_weights(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Scikit-learn "balanced" weights ``n / (k * n_c)`` per class."""
    g = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    # totals come from the (few-row) class table itself, as scalar subqueries
    n_total = g.agg(F.sum("n_class")).scalar()
    n_classes = g.agg(F.count(F.lit(1))).scalar()
    return g.select(label_col, "n_class", (n_total / (n_classes * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    """Attach A27 weights. There is one row per class, so they are broadcast: a shuffle
    by class would send all texts of a class to one task."""
    w = balanced_class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label_col, "left")


def few_shot_examples(dataset: DataFrame, label_col: str = "label", id_col: str = "id",
                      seed: int = SEED, type_col: str | None = "type", method: str = "md5") -> DataFrame:
    """At most one example per class, picked by the smallest seeded hash of
    the id (ties: the smallest id), liveblogs excluded. The pick is made on label
    and id alone; the rows themselves come from a semi join with the picked ids."""
    d = dataset
    if type_col and type_col in d.columns:
        d = d.where(~F.col(type_col).eqNullSafe("liveblog"))
    keyed = d.select(F.col(label_col).alias("_label"), F.col(id_col).alias("_id"), id_hash(id_col, seed, method).alias("_h"))
    least = keyed.groupBy("_label").agg(F.min("_h").alias("_least"))  # a long per class: hash aggregate
    ties = keyed.join(least.withColumnRenamed("_label", "_l"), (F.col("_h") == F.col("_least")) & F.col("_label").eqNullSafe(F.col("_l")))
    picked = ties.groupBy("_label").agg(F.min("_id").alias("_id"))
    return d.join(picked, (F.col(id_col) == F.col("_id")) & F.col(label_col).eqNullSafe(F.col("_label")), "left_semi")


def term_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """M3's statistics in SQL terms: for every term (lower case, two or more word
    characters) the number of texts it occurs in and its smooth idf
    ``ln((1 + n) / (1 + df)) + 1``. Stop words are not removed here."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)))
    n = df.count()  # one number
    counts = df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)


# scikit-learn's default token pattern: two or more word characters.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"


def read_stop_words(path: str) -> list[str]:
    """A stop list from a file with one word a line (blank lines and ``#`` comments
    aside): any list can be used without being part of this package."""
    with open(path, encoding="utf-8") as lines:
        return [w for w in (line.split("#")[0].strip() for line in lines) if w]


def term_stages(text_col: str = "text", stop_words: list[str] | None = None) -> list:
    """M3's tokens (scikit-learn's default pattern, lower case) without stop words
    (default: Spark's English list), as column ``_terms``."""
    return [RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
            StopWordsRemover(inputCol="_tokens", outputCol="_terms", stopWords=list(stop_words) if stop_words is not None
                             else StopWordsRemover.loadDefaultStopWords("english"))]


def top_terms(rows: DataFrame, n: int, terms_col: str = "_terms") -> list[str]:
    """The ``n`` terms with most occurrences, equal counts in order of the term: a
    top-k, so that ``n`` rows reach the driver. Same rows, same vocabulary."""
    counts = rows.select(F.explode(terms_col).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(n).collect()]


@dataclass(frozen=True)
class Tfidf:
    """M3 fitted: the stages up to ``features`` and what they were fitted to. All
    vectors on the way are sparse."""

    stages: PipelineModel
    vocabulary: list[str]
    doc_freq: list[int]
    n_docs: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``: term counts times smooth idf, of length 1."""
        return self.stages.transform(df).drop("_tokens", "_terms", "_tf", "_tfidf")

    def idf(self) -> list[float]:
        """scikit-learn's smooth idf ``ln((1 + n) / (1 + df)) + 1``."""
        return [math.log((1.0 + self.n_docs) / (1.0 + d)) + 1.0 for d in self.doc_freq]

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term, position, df, idf) of the vocabulary."""
        rows = list(zip(self.vocabulary, range(len(self.vocabulary)), map(int, self.doc_freq), self.idf(), strict=True))
        return spark.createDataFrame(rows, "term string, position int, df long, idf double")


def fit_tfidf(train: DataFrame, text_col: str = "text", vocab_size: int = 10000, stop_words: list[str] | None = None) -> Tfidf:
    """M3: the ``vocab_size`` most frequent terms of the training texts and their idf.

    The weights stay in sparse vectors: ``CountVectorizerModel`` counts the terms of
    the given vocabulary, ``ElementwiseProduct`` multiplies by the idf, ``Normalizer``
    divides by the length. Two passes over the training texts: one for the
    vocabulary, one for the document frequencies."""
    prepared = PipelineModel(term_stages(text_col, stop_words))
    rows = prepared.transform(train.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))
    vocabulary = top_terms(rows, vocab_size)
    if not vocabulary:
        raise ValueError("no terms in the training texts")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_tf")
    idf = IDF(inputCol="_tf", outputCol="_unused").fit(counter.transform(rows))
    # Spark's idf is ln((n + 1) / (df + 1)); the smooth one is 1 more
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_tfidf")
    fill = SQLTransformer(statement=f"SELECT * EXCEPT (`{text_col}`), coalesce(`{text_col}`, '') AS `{text_col}` FROM __THIS__")
    stages = PipelineModel([fill, *prepared.stages, counter, scale, Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)])
    return Tfidf(stages, vocabulary, [int(d) for d in idf.docFreq], int(idf.numDocs))


def sparse_entries(vector_col: str = "features") -> Column:
    """The entries of a sparse vector as ``array<struct<position, value>>``, without
    making it dense. The vector's parts are reached through its JSON form."""
    parts = F.from_json(F.to_json(F.struct(F.col(vector_col).alias("v"))), "v struct<indices:array<int>,values:array<double>>")["v"]
    return F.zip_with(parts["indices"], parts["values"], lambda i, x: F.struct(i.alias("position"), x.alias("value")))


#: Feature rows in one task of the optimiser: a task for fewer costs more than its
#: rows, and one for more would hold more than some hundred MB.
FIT_ROWS = (8_000, 100_000)


def fit_partitions(spark: SparkSession, n_rows: int) -> int:
    """Partitions of the rows that an optimiser reads some hundred times: one per core,
    fewer for few rows, more for many (:data:`FIT_ROWS`)."""
    least, most = FIT_ROWS
    return max(1, min(spark.sparkContext.defaultParallelism, -(-n_rows // least)), -(-n_rows // most))


def fit_features(train: DataFrame, label_col: str = "label", text_col: str = "text", vocab_size: int = 10000,
                 stop_words: list[str] | None = None):
    """M3 fitted on ``train``: ``(feature_model, weighted feature rows)``; the rows
    are checkpointed in the shared folder, so the optimiser (and a lost
    executor) reads them instead of running the features again. They are dealt evenly
    to :func:`fit_partitions`, whatever their classes, since every iteration waits for its longest task."""
    feats = fit_tfidf(train, text_col, vocab_size, stop_words)
    tr = feats.transform(with_class_weights(train, label_col))
    tr = tr.select("features", F.col(label_col).cast("double").alias(label_col), "weight")
    ensure_checkpoint_dir(train.sparkSession)
    return feats, tr.repartition(fit_partitions(train.sparkSession, feats.n_docs)).checkpoint(eager=True)


def classifier(n_rows: int, label_col: str = "label", max_iter: int = 1000, reg_param: float | None = None) -> LogisticRegression:
    """M4's estimator: multinomial logistic regression with class weights and
    ``regParam = 1/n`` (scikit-learn's C=1 with weights summing to n)."""
    return LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="weight",
                              family="multinomial", maxIter=max_iter, standardization=False,
                              regParam=reg_param if reg_param is not None else 1.0 / max(n_rows, 1),
                              elasticNetParam=0.0)


def fit_classifier(rows: DataFrame, label_col: str = "label", max_iter: int = 1000, reg_param: float | None = None):
    """M4 on the rows of :func:`fit_features`."""
    n = rows.count()  # one bounded scalar, needed for regParam
    return classifier(n, label_col, max_iter, reg_param).fit(rows)


def optimality(model, rows: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    """A certificate for a fitted M4 model: one row ``(n_rows, n_classes, n_terms,
    iterations, objective, residual, residual_at_zero)``.

    The objective ``sum(w * log loss) / sum(w) + regParam / 2 * |b|^2`` is convex, so a model
    is optimal where its gradient is 0; ``residual`` is the gradient's largest
    entry, ``residual_at_zero`` that of the model of all zeros, a scale to judge it by. The gradient is one aggregate over the sparse entries of the rows: by
    term, and for the intercepts over all rows, the sum by class of ``w * (p - y) * x``."""
    k, reg = model.numClasses, model.getOrDefault("regParam")
    beta = model.coefficientMatrix.toArray()
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    y, w = F.col(label_col).cast("int"), F.col(weight_col)
    slopes = [(w * (F.col("_p")[c] - (y == c).cast("double"))).alias(f"_s{c}") for c in range(k)]
    slopes += [(w * (F.lit(1.0 / k) - (y == c).cast("double"))).alias(f"_s{k + c}") for c in range(k)]  # of the model of zeros
    loss = -w * F.log(F.greatest(F.element_at("_p", y + 1), F.lit(1e-300)))
    whole = scored.select(w.alias("_w"), loss.alias("_loss"), *slopes).agg(
        F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum("_loss").alias("loss"), *[F.sum(f"_s{c}").alias(f"g{c}") for c in range(2 * k)]).first()
    entries = scored.select(F.explode(sparse_entries()).alias("e"), *slopes)
    terms = entries.groupBy(F.col("e.position").alias("position")).agg(*[F.sum(F.col(f"_s{c}") * F.col("e.value")).alias(f"g{c}") for c in range(2 * k)])
    spark = rows.sparkSession
    weights = spark.createDataFrame([(j, *map(float, beta[:, j])) for j in range(beta.shape[1])], "position int, " + ", ".join(f"b{c} double" for c in range(k)))
    mean = [F.coalesce(F.col(f"g{c}"), F.lit(0.0)) / F.lit(whole["w"]) for c in range(2 * k)]
    steps = [F.abs(mean[c] + F.lit(reg) * F.col(f"b{c}")) for c in range(k)]
    intercepts, at_zero = (max(abs(whole[f"g{c}"]) / whole["w"] for c in part) for part in (range(k), range(k, 2 * k)))
    objective = whole["loss"] / whole["w"] + reg / 2 * float((beta ** 2).sum())
    return weights.join(terms, "position", "left").agg(
        F.lit(whole["n"]).cast("long").alias("n_rows"), F.lit(k).alias("n_classes"), F.count("*").alias("n_terms"),
        F.lit(int(model.summary.totalIterations)).alias("iterations"), F.lit(objective).alias("objective"),
        F.greatest(F.max(F.greatest(*steps)), F.lit(intercepts)).alias("residual"),
        F.greatest(F.max(F.greatest(*map(F.abs, mean[k:]))), F.lit(at_zero)).alias("residual_at_zero"))


def fit_logistic(train: DataFrame, label_col: str = "label", max_iter: int = 1000,
                 reg_param: float | None = None, text_col: str = "text", vocab_size: int = 10000, stop_words: list[str] | None = None):
    """M3 + M4: ``(feature_model, lr_model)``."""
    feats, rows = fit_features(train, label_col, text_col, vocab_size, stop_words)
    return feats, fit_classifier(rows, label_col, max_iter, reg_param)


def predict(feats, model, df: DataFrame, label_col: str = "label") -> DataFrame:
    """Score rows with a fitted pair; ``y_pred`` is the class index as int."""
    out = model.transform(feats.transform(df))
    return out.withColumn("y_pred", F.col("prediction").cast("int")) \
              .withColumn("y_true", F.col(label_col).cast("int"))


def search_by_mae(train: DataFrame, val: DataFrame, grid: list[dict], label_col: str = "label", max_iter: int = 1000,
                  text_col: str = "text", parallelism: int = 4, vocab_size: int = 10000, stop_words: list[str] | None = None):
    """M11 (re-aimed): one model per setting of ``grid`` (built with
    ``ParamGridBuilder`` over the parameters of :func:`classifier`), ``parallelism``
    fits at a time; the one with the lowest validation MAE wins, of equal ones the
    first. Returns ``(place in the grid, feature model, model, MAE of every setting)``.

    Features are fitted once, and the validation rows' features are checkpointed like
    the training rows', since every setting reads both. The validation rows are those
    given: ``TrainValidationSplit`` would draw its own at random."""
    feats, rows = fit_features(train, label_col, text_col, vocab_size, stop_words)
    held = feats.transform(val).select("features", F.col(label_col).cast("double").alias(label_col)).checkpoint(eager=True)
    error = RegressionEvaluator(metricName="mae", labelCol=label_col, predictionCol="prediction")
    fits = classifier(rows.count(), label_col, max_iter).fitMultiple(rows, grid)
    models, scores = [None] * len(grid), [float("nan")] * len(grid)

    def one(_):
        place, fit = next(fits)  # thread-safe; each call fits one setting
        models[place], scores[place] = fit, error.evaluate(fit.transform(held))

    with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
        pool.map(inheritable_thread_target(train.sparkSession)(one), range(len(grid)), chunksize=1)
    best = min(range(len(grid)), key=lambda k: (math.isnan(scores[k]), scores[k], k))
    return best, feats, models[best], scores


def reg_grid(reg_params: list[float]) -> list[dict]:
    """A ``ParamGridBuilder`` grid over ``regParam``."""
    return ParamGridBuilder().addGrid(classifier(1).regParam, reg_params).build()


def select_by_mae(train: DataFrame, val: DataFrame, reg_params: list[float], label_col: str = "label",
                  max_iter: int = 1000, text_col: str = "text", parallelism: int = 4):
    """M11 over regularisations: ``(best_reg, feats, model, val_mae_by_reg)``."""
    best, feats, model, scores = search_by_mae(train, val, reg_grid(reg_params), label_col, max_iter, text_col, parallelism)
    return reg_params[best], feats, model, dict(zip(reg_params, scores, strict=True))
