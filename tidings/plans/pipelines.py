"""User-level pipelines (E1-E6): compositions of the operators.

Each returns DataFrames (lazy) or writes through the sinks; none collects
rows on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions import dates, parse, text
from tidings.operators import labels as L
from tidings.operators import learn, metrics, profile, scoring
from tidings.operators import series as S
from tidings.session import stage


@dataclass
class MarketReport:
    combined: DataFrame
    stats: DataFrame
    lags: DataFrame


def sentiment_market_report(labels: DataFrame, prices: DataFrame, lenient: bool = False,
                            series_col: str | None = None, id_col: str = "article_id",
                            label_col: str = "label", align: str = "joined") -> MarketReport:
    """Labels -> article dates (P1/P2) -> daily mean (A3) joined to daily
    returns (W1, J3) -> smoothing, leads, directions (W2, W3, P21) ->
    correlation, lagged correlation and directional accuracy (A17-A19).

    ``prices``: ``(symbol, ts, close)``. ``series_col``: a label column naming
    the symbol each label belongs to; without it one sentiment series is
    joined to every symbol.
    """
    d = labels.withColumn("date", dates.article_date(id_col, lenient))
    keys = [series_col] if series_col else None
    daily = S.daily_mean(d, "date", label_col, keys)
    closes = S.daily_close(prices)  # one row per symbol and UTC day, partially aggregated
    comb = S.combine_prices(daily, closes, series_col, align=align)
    return MarketReport(comb, S.market_stats(comb), S.lag_correlations(comb))


@dataclass
class Consensus:
    labels: DataFrame
    agreement: DataFrame
    distribution: DataFrame


def build_consensus_labels(rater_a: DataFrame, rater_b: DataFrame, rounded: bool = True) -> Consensus:
    """Two raters' long label tables -> consensus (A7/A8), overlap and
    disagreement (A5, A6), class distribution (A4)."""
    a = rater_a.withColumn("rater", F.lit("a")).select("article_id", "rater", "label")
    b = rater_b.withColumn("rater", F.lit("b")).select("article_id", "rater", "label")
    long = a.unionByName(b)
    cons = L.consensus(long, rounded=rounded)
    return Consensus(cons, L.rater_agreement(L.pair_wide(long, "a", "b")), L.label_distribution(cons))


def range_dashboard(labels: DataFrame, start=None, end=None, default_days: int = 30,
                    id_col: str = "article_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(daily, data_range, kpis)``; without ``start``/``end`` the KPIs
    cover the default range ``[max(min, max-30d), max]``."""
    d = labels.withColumn("date", dates.strict_article_date(id_col))
    daily = S.daily_mean(d)
    rng = S.data_range(daily, default_days)
    if start is None and end is None:
        kpis = S.default_range_kpis(daily, default_days)
    else:
        kpis = S.range_kpis(daily, start, end)
    return daily, rng, kpis


def article_profile(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(counts per type, statistics per type with an 'all' total row)``."""
    return profile.type_counts(articles), profile.type_statistics_with_total(articles)


def labelling_run(articles: DataFrame, scorer_factory: Callable, previous: DataFrame | None = None,
                  prompt: str = "simple", batch_size: int = scoring.BATCH_SIZE, join_hint: str | None = None) -> DataFrame:
    """E5: drop liveblogs (F1), skip ids already labelled (M7), build the
    prompt (P8/P9), score (M5), parse (P15) with failures kept apart (M6),
    plus token estimates for the usage report (A23)."""
    a = profile.drop_liveblogs(articles).where(F.col("id").isNotNull())
    a = scoring.not_yet_scored(a, previous, join_hint=join_hint)
    p = text.sectioned_prompt() if prompt == "sectioned" else text.simple_prompt()
    a = a.withColumn("prompt", p).withColumn("prompt_tokens", text.estimate_tokens("prompt"))
    scored = scoring.score_texts(a, scorer_factory, "id", "prompt", batch_size, keep=["prompt_tokens"])
    return scoring.token_usage(scoring.with_label(scored))


def evaluate_prompting(dataset: DataFrame, scorer_factory: Callable, label_col: str = "label",
                       seed: int = learn.SEED, batch_size: int = scoring.BATCH_SIZE,
                       hash_method: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Few-shot examples (W5) are drawn and excluded (J5); zero-shot
    and few-shot chat messages (P10, P11) are scored in one pass with ``mode``
    as a column, over one build of the dataset; what all rows of a mode have in
    common (system prompt, examples) goes to the tasks once; answers parsed by first digit (P17). Returns
    ``(predictions(mode, id, y_true, y_pred), summary by mode)``."""
    picked = learn.few_shot_examples(dataset.select("id", label_col, *(["type"] if "type" in dataset.columns else [])), label_col, "id", seed, method=hash_method)
    ids = [r["id"] for r in picked.select("id").collect()]  # one per class
    examples = dataset.where(F.col("id").isin(ids)).select("id", F.col(label_col).cast("int").alias("k"), "text").collect() if ids else []
    shots = "".join(f"{scoring.ARTICLE_HEAD}{r['text']}\n{r['k']}\n" for r in sorted(examples, key=lambda r: (r["k"], r["text"])))
    system = scoring.EVAL_SYSTEM_PROMPT + "\n"
    modes = F.array(F.lit("zero_shot"), F.lit("few_shot"))
    rest = (dataset.where(~F.col("id").isin(ids)) if ids else dataset).select(
        F.col("id"), F.col(label_col).cast("int").alias("y_true"), scoring.article_message("text").alias("message"), F.explode(modes).alias("mode"))
    flat = rest.withColumn("key", F.concat_ws("#", "mode", "id"))
    scored = scoring.score_texts(flat, scorer_factory, "key", "message", batch_size, keep=["mode", "id", "y_true"],
                                 prefixes={"zero_shot": system, "few_shot": system + shots}, prefix_col="mode")
    preds = scored.select("mode", "id", "y_true", parse.parse_first_digit("raw_response").alias("y_pred"))
    return preds, metrics.evaluation_summary(preds, ["mode"])


def compare_predictors(preds: DataFrame, model_a: str, model_b: str, id_col: str = "article_id") -> dict:
    """Two predictors over the same articles, aligned by id
    (never by position): per-model accuracy and MAE (A13), agreement and
    correlation (A14, A15), aligned histogram (A16)."""
    a = preds.where(F.col("model") == model_a).select(id_col, F.col("y_pred").alias("pred_a"))
    b = preds.where(F.col("model") == model_b).select(id_col, F.col("y_pred").alias("pred_b"))
    both = a.join(b, id_col, "inner")
    common = preds.where(F.col("model").isin(model_a, model_b)).join(both.select(id_col), id_col, "left_semi")
    return {"summary": metrics.evaluation_summary(common),
            "agreement": metrics.agreement(both),
            "histogram": metrics.prediction_histogram(common, [model_a, model_b])}


def baseline_run(dataset: DataFrame, polarity_factory: Callable, label_col: str = "label",
                 max_iter: int = 1000) -> DataFrame:
    """The labelled dataset -> (1) TF-IDF + logistic regression trained
    on the hash split's train part, (2) a polarity scorer bucketed to five
    classes; both evaluated on the test part (A13). The dataset (often a join of
    texts and labels) is read some six times, so it is staged once."""
    d = learn.hash_split(dataset.select("id", "text", F.col(label_col).cast("int").alias(label_col)), "id")
    d = stage(d, "baseline")
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    feats, model = learn.fit_logistic(train, label_col, max_iter=max_iter)
    lr = learn.predict(feats, model, test, label_col).select(F.lit("logistic_regression").alias("model"),
                                                            "id", "y_true", "y_pred")
    pol = scoring.score_polarity(test.withColumn("y_true", F.col(label_col).cast("int")), polarity_factory, keep=["y_true"])
    pol = pol.select(F.lit("polarity").alias("model"), "id", "y_true", F.col("label").alias("y_pred"))
    return metrics.evaluation_summary(lr.unionByName(pol))
