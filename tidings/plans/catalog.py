"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query runs a library operator over whole driver tables (through the
fixture views of :mod:`tidings.sources.views`) and returns a DataFrame whose
columns and types match the DuckDB oracle in :mod:`tidings.plans.oracle`.
Floating results are rounded to 9 places for the value-hash comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions import dates
from tidings.functions import parse as PA
from tidings.functions import text as TX
from tidings.operators import labels as L
from tidings.operators import learn as LE
from tidings.operators import metrics as M
from tidings.operators import profile as PR
from tidings.operators import scoring as SC
from tidings.operators import series as S
from tidings.operators.lexicon import lexicon_factory
from tidings.plans import pipelines as PL
from tidings.session import checkpoint_root, stage
from tidings.sources import readers as RD
from tidings.sources import views as V
from tidings.sources import writers as WR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Round every double column (oracle comparison hashes exact values)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- labels

def consensus_labels(spark, sf_dir) -> DataFrame:
    return L.consensus(V.rater_labels(spark, sf_dir))


register("consensus_labels")(consensus_labels)


def _daily(spark, sf_dir, lenient=False) -> DataFrame:
    c = consensus_labels(spark, sf_dir)
    dated = c.select("article_id", "label", dates.article_date("article_id", lenient).alias("date"))
    return S.daily_mean(dated)


@register("daily_sentiment")
def daily_sentiment(spark, sf_dir):
    return rounded(_daily(spark, sf_dir))


@register("daily_sentiment_lenient")
def daily_sentiment_lenient(spark, sf_dir):
    return rounded(_daily(spark, sf_dir, lenient=True))


@register("dashboard_kpis")
def dashboard_kpis(spark, sf_dir):
    return rounded(S.default_range_kpis(_daily(spark, sf_dir), default_days=30))


@register("dashboard_rollup")
def dashboard_rollup(spark, sf_dir):
    """A3 + A20 + A21 from a stored rollup: the consensus labels arrive in three
    lots (by the day of the month), one lot is written twice, the first two are compacted."""
    from tidings.operators import rollup
    store = checkpoint_root(spark, "rollup")
    c = consensus_labels(spark, sf_dir)
    dated = c.select("label", dates.article_date("article_id", False).alias("date"))
    states = stage(rollup.day_states(dated), "day-states")  # the only pass over the labels
    for lot in (0, 1, 1, 2):
        rollup.write_changes(states.where(F.dayofmonth("date") % 3 == lot), store, lot)
        if lot == 1:
            rollup.compact(spark, store)
    return rounded(S.default_range_kpis(rollup.daily(rollup.read_states(spark, store)), default_days=30))


@register("rater_agreement")
def rater_agreement(spark, sf_dir):
    wide = L.pair_wide(V.rater_labels(spark, sf_dir), "a", "b")
    return rounded(L.rater_agreement(wide))


@register("label_distribution")
def label_distribution(spark, sf_dir):
    return rounded(L.label_distribution(consensus_labels(spark, sf_dir)))


@register("merged_label_batches")
def merged_label_batches(spark, sf_dir):
    return L.merge_label_files(V.label_batches(spark, sf_dir))


@register("merge_file_stats")
def merge_file_stats(spark, sf_dir):
    return L.merge_file_stats(V.label_batches(spark, sf_dir))


# ---------------------------------------------------------------- market series

MIN_ORDERS_PER_DAY = 3  # days with fewer orders become price gaps (forward-filled)


def _combined(spark, sf_dir, by_segment=False) -> DataFrame:
    signal = V.daily_signal(spark, sf_dir, by_segment=by_segment)
    prices = V.daily_prices(spark, sf_dir, by_segment=by_segment, min_orders=MIN_ORDERS_PER_DAY)
    return S.combine_prices(signal, prices, "series")


@register("market_combined")
def market_combined(spark, sf_dir):
    return rounded(_combined(spark, sf_dir))


@register("market_stats")
def market_stats(spark, sf_dir):
    return rounded(S.market_stats(_combined(spark, sf_dir)))


@register("segment_market_stats")
def segment_market_stats(spark, sf_dir):
    return rounded(S.market_stats(_combined(spark, sf_dir, by_segment=True)))


@register("lag_correlations")
def lag_correlations(spark, sf_dir):
    return rounded(S.lag_correlations(_combined(spark, sf_dir, by_segment=True)))


@register("segment_returns")
def segment_returns(spark, sf_dir):
    prices = V.daily_prices(spark, sf_dir, by_segment=True, min_orders=MIN_ORDERS_PER_DAY)
    return rounded(S.daily_returns(prices))


@register("tick_features")
def tick_features(spark, sf_dir):
    """W1-W3 on one long series: every order is a tick of the same series (every ninth
    without a price), in slices of 2,000 rows."""
    from tidings.operators.sliced import sliced_features
    o = V.table(spark, sf_dir, "orders")
    ticks = o.select("o_orderkey", F.lit("all").alias("symbol"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("close"),
                     (F.col("o_custkey") % 5).cast("double").alias("sentiment"))
    out = sliced_features(ticks, ["ts", "o_orderkey"], smooth=("sentiment",), slice_rows=2000)
    return rounded(out.select("o_orderkey", "return", "return_smoothed", "sentiment_smoothed", "return_lead1", "return_lead5"))


@register("returns_date_slice")
def returns_date_slice(spark, sf_dir):
    r = S.daily_returns(V.daily_prices(spark, sf_dir, by_segment=True, min_orders=MIN_ORDERS_PER_DAY))
    return rounded(S.price_range(r, start="1996-01-01", end="1997-01-01"))


@register("returns_trailing_period")
def returns_trailing_period(spark, sf_dir):
    r = S.daily_returns(V.daily_prices(spark, sf_dir, by_segment=True, min_orders=MIN_ORDERS_PER_DAY))
    return rounded(S.price_range(r, period_days=365))


# ---------------------------------------------------------------- evaluation metrics


@register("eval_summary")
def eval_summary(spark, sf_dir):
    return rounded(M.evaluation_summary(V.predictions(spark, sf_dir)))


@register("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(V.predictions(spark, sf_dir))


@register("classification_report")
def classification_report(spark, sf_dir):
    return rounded(M.classification_report(V.predictions(spark, sf_dir), classes=M.CLASSES))


@register("classification_report_seen")
def classification_report_seen(spark, sf_dir):
    return rounded(M.classification_report(V.predictions(spark, sf_dir)))


def _pair(spark, sf_dir) -> DataFrame:
    p = V.predictions(spark, sf_dir)
    a = p.where(F.col("model") == "rater_b").select("article_id", F.col("y_pred").alias("pred_a"))
    b = p.where(F.col("model") == "length").select("article_id", F.col("y_pred").alias("pred_b"))
    return a.join(b, "article_id", "inner")


@register("predictor_agreement")
def predictor_agreement(spark, sf_dir):
    return rounded(M.agreement(_pair(spark, sf_dir)))


@register("prediction_histogram")
def prediction_histogram(spark, sf_dir):
    return M.prediction_histogram(V.predictions(spark, sf_dir), ["rater_b", "length"])


@register("class_weights")
def class_weights(spark, sf_dir):
    from tidings.operators.learn import balanced_class_weights
    c = consensus_labels(spark, sf_dir).select(PA.to_int_label("label").alias("label"))
    return rounded(balanced_class_weights(c))


# ---------------------------------------------------------------- article profile

@register("article_type_counts")
def article_type_counts(spark, sf_dir):
    return PR.type_counts(V.articles(spark, sf_dir))


@register("article_type_stats")
def article_type_stats(spark, sf_dir):
    return rounded(PR.type_statistics(V.articles(spark, sf_dir)))


@register("article_stats_rollup")
def article_stats_rollup(spark, sf_dir):
    return rounded(PR.type_statistics_with_total(V.articles(spark, sf_dir)))


@register("article_data_check")
def article_data_check(spark, sf_dir):
    return rounded(PR.data_check(V.articles(spark, sf_dir)))


def _exclusions(spark, sf_dir) -> DataFrame:
    """Ids to hold out: documents the driver's ``labels`` table marks toxic."""
    lab = V.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return V.articles(spark, sf_dir).join(lab, "doc_id", "left_semi").select(F.col("id").alias("article_id"))


@register("eval_dataset")
def eval_dataset(spark, sf_dir):
    a = V.articles(spark, sf_dir)
    d = PR.prepare_dataset(a, consensus_labels(spark, sf_dir), exclude=_exclusions(spark, sf_dir))
    return d.select("id", "label", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


# ---------------------------------------------------------------- text, prompts, parsing

@register("document_word_counts")
def document_word_counts(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.word_count("text").cast("long").alias("n_words"),
                    TX.estimate_tokens("text").alias("est_tokens"))


@register("page_text")
def page_text(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    stripped = TX.strip_html("html")
    return p.select("page_id", F.length(stripped).cast("long").alias("text_chars"),
                    TX.word_count(stripped).cast("long").alias("n_words"),
                    F.md5(stripped).alias("text_md5"))


@register("labelling_prompts")
def labelling_prompts(spark, sf_dir):
    a = PR.drop_liveblogs(V.articles(spark, sf_dir))
    sect = TX.sectioned_prompt()
    simple = TX.simple_prompt()
    return a.select("id", F.md5(sect).alias("sectioned_md5"), TX.estimate_tokens(sect).alias("sectioned_tokens"),
                    F.md5(simple).alias("simple_md5"), TX.estimate_tokens(simple).alias("simple_tokens"),
                    F.md5(TX.plain_text()).alias("plain_md5"),
                    F.length(TX.trimmed_text()).cast("long").alias("trimmed_chars"),
                    F.md5(TX.body_prefix()).alias("body_md5"))


@register("prompt_prefixes")
def prompt_prefixes(spark, sf_dir):
    """The reference's cuts of P5, P6, P8 and P9 as explicit arguments: 2000 and 1500 code points."""
    a = PR.drop_liveblogs(V.articles(spark, sf_dir))
    return a.select("id", F.md5(TX.title_body(n=2000)).alias("title_body_md5"), F.md5(TX.body_prefix(n=2000)).alias("body_md5"),
                    F.md5(TX.sectioned_prompt(n=1500)).alias("sectioned_md5"), F.md5(TX.simple_prompt(n=2000)).alias("simple_md5"))


@register("default_article_ids")
def default_article_ids(spark, sf_dir):
    """Missing ids (here: of every seventh article) -> ``article_<position>`` by W6, and missing types."""
    a = V.articles(spark, sf_dir).withColumn("id", F.when(F.col("doc_id") % 7 != 0, F.col("id")))
    i = PR.with_row_index(a.select("doc_id", "id", "type"), "doc_id")
    return i.select("doc_id", TX.default_article_id("id", "idx").alias("id"), TX.default_text("type").alias("type"))


@register("cost_estimate")
def cost_estimate(spark, sf_dir):
    a = PR.drop_liveblogs(V.articles(spark, sf_dir))
    return rounded(SC.cost_estimate(a, TX.sectioned_prompt()))


@register("answer_parsing")
def answer_parsing(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn",
                    PA.parse_label_strict("text").alias("strict_label"),
                    PA.parse_sentiment_ladder("text").alias("ladder"),
                    PA.parse_sentiment_ladder("text", mode="reference").alias("ladder_reference"),
                    PA.parse_first_digit("text").alias("first_digit"))


@register("polarity_buckets")
def polarity_buckets(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in ["negative", "neutral", "positive", "Positive", "mixed"]])
    lab = F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))
    score = (F.col("n_chars") % 100) / 100.0
    return d.select("doc_id", lab.alias("polarity"), F.round(score, 9).alias("score"),
                    PA.bucket_polarity(lab, score).alias("label"),
                    PA.label_name(PA.bucket_polarity(lab, score)).alias("label_name"),
                    TX.is_blank("text").alias("blank_text"))


@register("chat_messages")
def chat_messages(spark, sf_dir):
    """P10: zero-shot chat messages for every turn (one row each, no grouping)."""
    c = V.table(spark, sf_dir, "conversations")
    m = SC.zero_shot_messages("text")
    return c.select("conv_id", "turn", F.size(m).alias("n_messages"),
                    F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
                    F.md5(F.array_join(F.transform(m, lambda x: x["content"]), "|")).alias("content_md5"))


# ---------------------------------------------------------------- scoring (pluggable scorer)


def _labelled_run(spark, sf_dir) -> DataFrame:
    a = V.articles(spark, sf_dir)
    return PL.labelling_run(a, lexicon_factory)


@register("scored_articles")
def scored_articles(spark, sf_dir):
    """M5 + M6 + P15 over every non-liveblog article (whole texts, prompt P9)."""
    return _labelled_run(spark, sf_dir).select("id", "raw_response", "status", "label", "prompt_tokens")


@register("labelling_usage")
def labelling_usage(spark, sf_dir):
    """A23 over the scored run (every answer is one digit -> 0 completion tokens)."""
    return rounded(SC.usage_summary(_labelled_run(spark, sf_dir)))


@register("labelling_batch_progress")
def labelling_batch_progress(spark, sf_dir):
    """Batches of 50 consecutive document ids."""
    run = _labelled_run(spark, sf_dir)
    idx = F.regexp_extract("id", r"doc-(\d+)$", 1).cast("long")
    return SC.batch_progress(run.withColumn("idx", idx), "idx", 50)


def _eval_dataset(spark, sf_dir) -> DataFrame:
    a = V.articles(spark, sf_dir)
    lab = consensus_labels(spark, sf_dir).select("article_id", PA.to_int_label("label").alias("label"))
    return PR.prepare_dataset(a, lab)


@register("prompting_eval")
def prompting_eval(spark, sf_dir):
    """Zero-shot vs few-shot over the labelled dataset; the few-shot
    examples are the seeded-md5 picks (W5) and are left out of the evaluation."""
    _, summary = PL.evaluate_prompting(_eval_dataset(spark, sf_dir), lexicon_factory, hash_method="md5")
    return rounded(summary)


@register("few_shot_examples")
def few_shot_examples(spark, sf_dir):
    """One example per class, picked by the smallest seeded md5 hash of
    the id (reproducible in SQL)."""
    ex = LE.few_shot_examples(_eval_dataset(spark, sf_dir), method="md5")
    return ex.select("label", "id")


# ---------------------------------------------------------------- splits and models

@register("chat_prompts")
def chat_prompts(spark, sf_dir):
    """The few-shot conversation of every article that is no example: roles in
    order and a hash of each message's content. The shared messages are stored once
    and referred to; no row holds an example's text."""
    d = _eval_dataset(spark, sf_dir)
    ids = [r["id"] for r in LE.few_shot_examples(d.select("id", "label", "type")).select("id").collect()]  # one per class
    prefix = SC.shared_prefix(d.where(F.col("id").isin(ids)).select("text", "label"))
    refs = SC.conversation_references(d.where(~F.col("id").isin(ids)), prefix)
    ordered = F.array_sort(F.collect_list(F.struct("position", "role", "message_id")))
    heads = prefix.groupBy("prefix_id").agg(F.array_join(ordered["role"], ",").alias("roles"), F.array_join(ordered["message_id"], ",").alias("ids"))
    return refs.join(heads, "prefix_id").select("id", F.concat("roles", F.lit(",user")).alias("roles"), F.concat("ids", F.lit(","), "message_id").alias("content_md5"))


@register("message_store")
def message_store(spark, sf_dir):
    """Every message of the few-shot conversations once, by its hash."""
    d = _eval_dataset(spark, sf_dir)
    ids = [r["id"] for r in LE.few_shot_examples(d.select("id", "label", "type")).select("id").collect()]  # one per class
    prefix = SC.shared_prefix(d.where(F.col("id").isin(ids)).select("text", "label"))
    store = SC.message_store(d.where(~F.col("id").isin(ids)), prefix)
    return store.select("message_id", "role", F.length("content").cast("long").alias("n_chars"))


@register("resumed_labelling")
def resumed_labelling(spark, sf_dir):
    """M7 + E5: a first run labels the articles that aren't Spanish, and every eleventh of
    its calls (by hash) fails; the second run labels what has no successful result.
    Articles and results are bucketed by id, so that they meet without a shuffle."""
    root, tag = checkpoint_root(spark, "resume"), uuid.uuid4().hex
    a = V.articles(spark, sf_dir).select("id", "type", "webTitle", "bodyText", "lang")
    WR.write_bucketed(a, f"articles_{tag}", f"{root}/articles", key="id", buckets=32)
    articles = spark.table(f"articles_{tag}")
    first = PL.labelling_run(articles.where("lang <> 'es'"), lexicon_factory)
    failed = LE.id_hash("id") % 11 == 0
    first = first.select("id", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), F.when(~failed, F.col("label")).alias("label"))
    WR.write_bucketed(first, f"results_{tag}", f"{root}/results", key="id", buckets=32)
    results = spark.table(f"results_{tag}")
    second = PL.labelling_run(articles, lexicon_factory, previous=results, join_hint="merge")
    runs = results.where("status = 'ok'").select("id", "status", "label", F.lit(1).alias("run"))
    return runs.unionByName(second.select("id", "status", "label", F.lit(2).alias("run")))


@register("hash_split")
def hash_split(spark, sf_dir):
    """M1: 70/15/15 hash split of all documents."""
    return LE.hash_split(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@register("hash_split_sizes")
def hash_split_sizes(spark, sf_dir):
    return hash_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split")
def stratified_split(spark, sf_dir):
    """M2: exact per-class stratified split of the consensus labels."""
    c = consensus_labels(spark, sf_dir).select(F.col("article_id").alias("id"), PA.to_int_label("label").alias("label"))
    return LE.stratified_split(c)


@register("stratified_split_sizes")
def stratified_split_sizes(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("term_statistics")
def term_statistics(spark, sf_dir):
    """M3: document frequency and smooth idf of every term of the documents."""
    return rounded(LE.term_statistics(V.table(spark, sf_dir, "documents")))


#: Stop words of the registered TF-IDF queries; the SQL has the same.
STOP_WORDS = ["the", "and", "of", "to", "in", "that", "with", "der", "die", "und", "les", "des", "los", "las"]


def _train_documents(spark, sf_dir) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return LE.hash_split(d).where(F.col("split") == "train")


@register("tfidf_vocabulary")
def tfidf_vocabulary(spark, sf_dir):
    """M3: the fitted model's 10,000 terms (by count, then term) with document frequency and smooth idf."""
    return rounded(LE.fit_tfidf(_train_documents(spark, sf_dir), stop_words=STOP_WORDS).terms(spark))


@register("tfidf_vectors")
def tfidf_vectors(spark, sf_dir):
    """M3: the fitted model's vector of every document, by its number of entries, their sum and the largest one."""
    model = LE.fit_tfidf(_train_documents(spark, sf_dir), stop_words=STOP_WORDS)
    d = model.transform(V.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", LE.sparse_entries().alias("e"))
    return d.select("doc_id", F.size("e").cast("long").alias("n_terms"), F.round(F.aggregate("e", F.lit(0.0), lambda s, e: s + e["value"]), 6).alias("weight_sum"),
                    F.round(F.coalesce(F.array_max(F.transform("e", lambda e: e["value"])), F.lit(0.0)), 6).alias("top_weight"))


def _language_data(spark, sf_dir) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    langs = ["de", "en", "es", "fr"]
    lab = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    return d.select(F.col("doc_id").alias("id"), "text", lab.cast("int").alias("label"))


@register("tfidf_logreg_eval")
def tfidf_logreg_eval(spark, sf_dir):
    """M1 + M3 + M4 + A9-A11: TF-IDF + balanced multinomial logistic
    regression predicting the document language from whole texts, scored
    on the validation and test splits (rows-only)."""
    data = LE.hash_split(_language_data(spark, sf_dir))
    train = data.where(F.col("split") == "train")
    feats, model = LE.fit_logistic(train)
    scored = LE.predict(feats, model, data.where(F.col("split") != "train"))
    return rounded(M.evaluation_summary(scored, ["split"]))


@register("model_certificate")
def model_certificate(spark, sf_dir):
    """M4: the language model fitted to the training documents is optimal: the
    gradient of its objective vanishes (its largest entry is below a hundredth of that of the model of zeros)."""
    data = LE.hash_split(_language_data(spark, sf_dir))
    _, rows = LE.fit_features(data.where(F.col("split") == "train"))
    row = LE.optimality(LE.fit_classifier(rows), rows)
    return row.select("n_rows", "n_classes", (F.col("iterations") < 1000).alias("finished"), (F.col("residual") < 0.01 * F.col("residual_at_zero")).alias("optimal"))


@register("regularisation_by_mae")
def regularisation_by_mae(spark, sf_dir):
    """Four language models, one per regularisation, fitted side by side over features that are fitted
    once; the chosen one, evaluated on the test split (rows-only)."""
    data = LE.hash_split(_language_data(spark, sf_dir))
    part = lambda x: data.where(F.col("split") == x)
    best, feats, model, scores = LE.select_by_mae(part("train"), part("val"), [1e-4, 1e-3, 1e-2, 1e-1])
    out = M.evaluation_summary(LE.predict(feats, model, part("test")), ["split"])
    return rounded(out.withColumn("reg_param", F.lit(best)).withColumn("val_mae", F.lit(scores[best])))


@register("baseline_models")
def baseline_models(spark, sf_dir):
    """TF-IDF + logistic regression and the polarity scorer on the same test split (rows-only)."""
    from tidings.operators.lexicon import lexicon_polarity_factory
    a = V.articles(spark, sf_dir)
    lab = consensus_labels(spark, sf_dir).select("article_id", PA.to_int_label("label").alias("label"))
    return rounded(PL.baseline_run(PR.prepare_dataset(a, lab, prompt_text=TX.plain_text()), lexicon_polarity_factory))


@register("scored_with_failures")
def scored_with_failures(spark, sf_dir):
    """M6: a scorer that fails on some texts; failures are isolated per row and
    carry the scorer's whole message."""
    def factory():
        def scorer(texts):
            if any(len(t) % 7 == 0 for t in texts):
                raise RuntimeError("no answer " * 60)
            return [str(len(t) % 5) for t in texts]
        return scorer
    d = V.table(spark, sf_dir, "documents")
    out = SC.with_label(SC.score_texts(d, factory, "doc_id", "text"))
    return out.select("doc_id", "status", "label", F.length("error").alias("error_chars"))


@register("argmax_classes")
def argmax_classes(spark, sf_dir):
    """Index of the largest of five scores, the first one on ties."""
    d = V.table(spark, sf_dir, "documents")
    scores = F.array(*[((F.col("doc_id") * (k + 3) + F.col("n_chars")) % 7).cast("double") for k in range(5)])
    return d.select("doc_id", PA.argmax_class(scores).alias("label"), PA.ladder_name(PA.argmax_class(scores)).alias("ladder"),
                    PA.label_value(PA.label_name(PA.argmax_class(scores))).alias("value"))


@register("consensus_unrounded")
def consensus_unrounded(spark, sf_dir):
    """Consensus as the plain mean, in steps of a half."""
    return L.consensus(V.rater_labels(spark, sf_dir), rounded=False)


# ---------------------------------------------------------------- streams

@register("stream_daily_events")
def stream_daily_events(spark, sf_dir):
    """Daily mean event value per type via a watermarked windowed stream
    over the landed ``events`` table; equals the batch aggregate."""
    from tidings.streaming.daily import stream_daily_from_table
    ev = V.table(spark, sf_dir, "events")
    out = stream_daily_from_table(ev, "ts", "value", ["event_type"])
    return rounded(out.select("date", "event_type", "sentiment", "n_articles"))


@register("incremental_labelling")
def incremental_labelling(spark, sf_dir):
    """Land articles in two waves, of which the second sends the first one
    again; every article is labelled once."""
    from tidings.streaming.labelling import latest_labels, run_labelling_stream
    root = checkpoint_root(spark, "labelling")
    landing, results, ck = f"{root}/landing", f"{root}/results", f"{root}/checkpoint"
    a = V.articles(spark, sf_dir).select("id", "type", "webTitle", "bodyText", "lang")
    a.where(F.col("lang") == "en").write.mode("append").parquet(landing)
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=a.schema)
    a.write.mode("append").parquet(landing)
    run_labelling_stream(spark, landing, results, ck, lexicon_factory, schema=a.schema)
    return latest_labels(spark, results).select("id", "status", "label")


# ---------------------------------------------------------------- sources and sinks round trips

@register("snapshot_merge")
def snapshot_merge(spark, sf_dir):
    """K1 + S1 + S2: write two article snapshots (the second re-titles the
    English articles), read both back, latest snapshot wins per id."""
    root = checkpoint_root(spark, "snapshots")
    a = V.articles(spark, sf_dir)
    nested = a.select("id", "type", "webTitle", "webUrl", "webPublicationDate",
                      F.struct("headline", "standfirst", "bodyText").alias("fields"))
    WR.write_table(nested, f"{root}/snap_1", fmt="json")
    upd = nested.join(a.where(F.col("lang") == "en").select("id"), "id", "left_semi") \
        .withColumn("webTitle", F.concat(F.col("webTitle"), F.lit(" (updated)")))
    WR.write_table(upd, f"{root}/snap_2", fmt="json")
    merged = RD.read_article_snapshots(spark, [f"{root}/snap_1", f"{root}/snap_2"], multiline=False)
    return merged.select("id", "type", "webTitle", F.md5(F.coalesce("bodyText", F.lit(""))).alias("body_md5"))


@register("snapshot_merge_incremental")
def snapshot_merge_incremental(spark, sf_dir):
    """S2 into a current table in 64 hash buckets: all articles, then a second snapshot
    that re-titles every 97th and has outdated rows of every 89th; ``rewritten`` tells
    whether the article's bucket was written again."""
    from tidings.sources import current
    store = checkpoint_root(spark, "current")
    a = V.articles(spark, sf_dir)
    first = a.select("id", "type", "webTitle", F.md5(F.coalesce("bodyText", F.lit(""))).alias("body_md5"), F.lit(1).alias("version"), "doc_id")
    current.merge(first.drop("doc_id"), store, 0, order=["version"])
    again = first.where(F.col("doc_id") % 97 == 0).withColumns({"webTitle": F.concat("webTitle", F.lit(" (updated)")), "version": F.lit(2)})
    outdated = first.where(F.col("doc_id") % 89 == 0).withColumns({"webTitle": F.lit("outdated"), "version": F.lit(0)})
    second = again.unionByName(outdated).drop("doc_id")
    for _ in range(2):  # as after a crash
        current.merge(second, store, 1, order=["version"])
    back = current.read_current(spark, store, second.schema)
    return back.select("id", "type", "webTitle", "body_md5", (F.col("gen") == 1).alias("rewritten"))


@register("label_map_roundtrip")
def label_map_roundtrip(spark, sf_dir):
    """S4 + U4: label batches written as JSON objects ``{id: label}`` (one file
    per batch), read back and merged (last batch in name order wins)."""
    root = checkpoint_root(spark, "label-maps")
    b = V.label_batches(spark, sf_dir)
    obj = b.groupBy("src_file").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("article_id", "label"))))).alias("value"))
    obj.repartition("src_file").write.mode("overwrite").partitionBy("src_file").text(f"{root}/maps")
    long = RD.read_label_map(spark, f"{root}/maps", rater="b", precedence="path")
    return L.merge_label_files(long)


@register("price_csv_roundtrip")
def price_csv_roundtrip(spark, sf_dir):
    """Daily closes written as CSV with a -05:00 offset timestamp, read
    back, returns computed (W1) on the UTC dates."""
    root = checkpoint_root(spark, "prices")
    p = V.daily_prices(spark, sf_dir, by_segment=True, min_orders=MIN_ORDERS_PER_DAY)
    csv = p.select(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00-05:00")).alias("Date"),
                   F.col("close").alias("Close"), F.col("symbol").alias("Symbol"))
    csv.write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    back = RD.read_prices(spark, f"{root}/csv")
    return rounded(S.daily_returns(S.daily_close(back)))


@register("article_arrays")
def article_arrays(spark, sf_dir):
    """S1 on its real format: files that each hold one JSON array of articles."""
    root = checkpoint_root(spark, "arrays")
    a = V.articles(spark, sf_dir)
    art = F.struct("id", "type", "webTitle", "webUrl", "webPublicationDate", F.struct("headline", "standfirst", "bodyText").alias("fields"))
    files = a.groupBy(F.floor(F.col("doc_id") / 500).alias("run")).agg(F.to_json(F.collect_list(art)).alias("value"))
    files.repartition("run").write.partitionBy("run").text(f"{root}/runs")
    back = RD.read_articles(spark, f"{root}/runs/*")
    return back.select("id", "type", "webPublicationDate", F.md5(F.coalesce("bodyText", F.lit(""))).alias("body_md5"))


@register("article_arrays_split")
def article_arrays_split(spark, sf_dir):
    """S1 on its real format, each file read by several tasks (ranges of 1 MB)."""
    from tidings.sources.json_split import read_articles_split
    root = checkpoint_root(spark, "arrays-split")
    a = V.articles(spark, sf_dir)
    art = F.struct("id", "type", "webTitle", "webUrl", "webPublicationDate", F.struct("headline", "standfirst", "bodyText").alias("fields"))
    files = a.groupBy(F.floor(F.col("doc_id") / 1000).alias("run")).agg(F.to_json(F.collect_list(art)).alias("value"))
    files.repartition("run").write.partitionBy("run").text(f"{root}/runs")
    back = read_articles_split(spark, f"{root}/runs", range_bytes=1 << 20)
    return back.select("id", "type", "webPublicationDate", F.md5(F.coalesce("bodyText", F.lit(""))).alias("body_md5"))


@register("label_map_split")
def label_map_split(spark, sf_dir):
    """S4 + J2: each rater's labels as JSON objects of up to 10,000 entries, read by several tasks a file (ranges
    of 64 KB), and their consensus."""
    from tidings.sources.json_split import read_label_map_split
    root = checkpoint_root(spark, "label-maps-split")
    r = V.rater_labels(spark, sf_dir)
    lot = F.floor(F.regexp_extract("article_id", r"(\d+)$", 1).cast("long") / 10000)
    obj = r.groupBy("rater", lot.alias("lot")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("article_id", "label")))).alias("value"))
    obj.write.partitionBy("rater", "lot").text(f"{root}/maps")
    maps = [read_label_map_split(spark, f"{root}/maps/rater={x}", rater=x, range_bytes=1 << 16) for x in ("a", "b")]
    return L.consensus(maps[0].unionByName(maps[1]))


@register("article_file_index")
def article_file_index(spark, sf_dir):
    """W6 and F7 in file order: positions over (file, place in the file)."""
    a = V.articles(spark, sf_dir).select("id", F.concat(F.lit("articles_"), (F.col("doc_id") % 9).cast("string"), F.lit(".json")).alias("file"),
                                         F.floor(F.col("doc_id") / 9).alias("pos"))
    return PR.with_row_index(a, ["file", "pos"]).select("id", "file", "idx")


def _search_pages(spark, sf_dir) -> DataFrame:
    """Search pages of 50 articles (newest first within a page) and the number of pages."""
    a = V.articles(spark, sf_dir)
    nested = a.select((F.floor(F.col("doc_id") / 50) + 1).cast("int").alias("page"),
                      F.struct("id", "type", "webTitle", "webUrl", "webPublicationDate",
                               F.struct("headline", "standfirst", "bodyText").alias("fields")).alias("art"))
    return nested.groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("art.webPublicationDate").alias("_d"),
                                             F.col("art.id").alias("_i"), F.col("art").alias("a"))),
                     asc=False).alias("_r"))


@register("assembled_search_pages")
def assembled_search_pages(spark, sf_dir):
    """Four collections of the same search pages. In ``error`` the middle page
    failed; in ``gap`` the page at two thirds never landed; in ``shrinking`` each page
    announces one page less than the one before; in ``unnumbered`` the pages from a quarter on announce no number.
    The texts are shuffled into pages once; the four copies of them land compressed."""
    root = checkpoint_root(spark, "pages")
    pages = stage(_search_pages(spark, sf_dir), "search-pages")
    pages = pages.withColumn("total", V.articles(spark, sf_dir).agg((F.floor(F.max("doc_id") / 50) + 1).cast("int")).scalar())
    announced = {"shrinking": F.col("total") + 3 - F.col("page"), "unnumbered": F.when(F.col("page") <= F.floor(F.col("total") / 4), F.col("total"))}
    out = None
    for run in ("error", "gap", "shrinking", "unnumbered"):
        status = F.when(F.lit(run == "error") & (F.col("page") == F.floor(F.col("total") / 2) + 1), "error").otherwise("ok")
        p = pages.where(~(F.lit(run == "gap") & (F.col("page") == F.floor(F.col("total") * 2 / 3) + 1)))
        p = p.select("page", F.struct(
            status.alias("status"), F.lit(None).cast("string").alias("message"), announced.get(run, F.col("total")).alias("pages"),
            F.col("page").alias("currentPage"), F.transform("_r", lambda e: e["a"]).alias("results")).alias("response"))
        WR.write_table(p, f"{root}/{run}", fmt="json", compression="gzip")
        landed = RD.read_search_pages(spark, f"{root}/{run}", multiline=False)
        one = RD.assemble_pages(landed).select(F.lit(run).alias("run"), "page", "pos", "id")
        out = one if out is None else out.unionByName(one)
    return out


@register("collection_window")
def collection_window(spark, sf_dir):
    """Articles published in the 730 days up to 1996-12-31."""
    a = V.articles(spark, sf_dir)
    w = RD.collection_window(a, "1996-12-31", 730)
    return w.groupBy(dates.publication_day("webPublicationDate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("articles_by_type_roundtrip")
def articles_by_type_roundtrip(spark, sf_dir):
    """K2 + K5: articles written partitioned by type, read back per type."""
    root = checkpoint_root(spark, "by-type")
    WR.write_by_type(V.articles(spark, sf_dir).drop("lang", "source", "n_chars", "doc_id"), f"{root}/out",
                     fmt="parquet")
    back = spark.read.parquet(f"{root}/out")
    return rounded(PR.type_statistics(back))


# ---------------------------------------------------------------- positions, top-k, polarity model

@register("article_index")
def article_index(spark, sf_dir):
    """Stable 0-based position of every article in document order."""
    return PR.with_row_index(V.articles(spark, sf_dir).select("id", "doc_id"), "doc_id").select("id", "idx")


@register("article_index_range")
def article_index_range(spark, sf_dir):
    """the labelling batch at positions [100, 150)."""
    return PR.index_range(V.articles(spark, sf_dir).select("id", "doc_id"), 100, 50, "doc_id").select("id", "idx")


def _indexed_articles(spark, sf_dir) -> tuple[str, str]:
    from tidings.sources import positions
    root = checkpoint_root(spark, "positions")
    WR.write_in_order(V.articles(spark, sf_dir), f"{root}/articles", ["doc_id"], files=16)
    positions.build_index(spark, f"{root}/articles", f"{root}/index")
    return f"{root}/articles", f"{root}/index"


@register("article_positions")
def article_positions(spark, sf_dir):
    """W6 from a stored index: every article's position without sorting the table."""
    from tidings.sources import positions
    return positions.with_position(spark, *_indexed_articles(spark, sf_dir)).select("id", "idx")


@register("article_position_range")
def article_position_range(spark, sf_dir):
    """F7 from a stored index: the labelling batch at positions [100, 150), whole articles;
    only the files that hold it are opened."""
    from tidings.sources import positions
    batch = positions.read_positions(spark, *_indexed_articles(spark, sf_dir), 100, 50)
    return batch.select("id", "idx", F.md5(F.coalesce("bodyText", F.lit(""))).alias("body_md5"))


@register("newest_articles")
def newest_articles(spark, sf_dir):
    """O3: the 50 newest articles."""
    return PR.newest(V.articles(spark, sf_dir), 50).select("id", "webPublicationDate")


def _polarity(spark, sf_dir) -> DataFrame:
    """Polarity scores of the labelled articles' headline, standfirst and body."""
    from tidings.operators.lexicon import lexicon_polarity_factory
    lab = consensus_labels(spark, sf_dir).select("article_id", PA.to_int_label("label").alias("y_true"))
    d = PR.prepare_dataset(V.articles(spark, sf_dir), lab, prompt_text=TX.plain_text())
    return SC.score_polarity(d, lexicon_polarity_factory, keep=["y_true", "webTitle"])


@register("polarity_eval")
def polarity_eval(spark, sf_dir):
    """M5 + P19 + P18 + A13: a 3-class polarity scorer bucketed to five
    classes, evaluated against the consensus labels."""
    preds = _polarity(spark, sf_dir).select(F.lit("polarity").alias("model"), "y_true", F.col("label").alias("y_pred"))
    return rounded(M.evaluation_summary(preds))


@register("predictor_articles")
def predictor_articles(spark, sf_dir):
    """M9 + J4: both modes of a run and the polarity model, joined by id to the
    truth and to the articles."""
    p = V.predictions(spark, sf_dir)
    runs = p.groupBy("article_id").agg(F.max(F.when(F.col("model") == "rater_b", F.col("y_pred"))).alias("zero_shot"),
                                       F.max(F.when(F.col("model") == "length", F.col("y_pred"))).alias("few_shot"))
    j = _polarity(spark, sf_dir).join(runs.where("zero_shot IS NOT NULL AND few_shot IS NOT NULL"), F.col("id") == F.col("article_id"))
    return j.select("id", "y_true", "zero_shot", "few_shot", F.col("label").alias("polarity"), F.md5("webTitle").alias("title_md5"))


@register("finetune_dataset")
def finetune_dataset(spark, sf_dir):
    """P4 + F4 + P24 + J1: stripped text of every labelled article."""
    d = PR.text_dataset(V.articles(spark, sf_dir), consensus_labels(spark, sf_dir))
    return d.select("id", "label", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


@register("latest_snapshot")
def latest_snapshot(spark, sf_dir):
    """S3: of two article snapshots (all articles, then the English ones),
    only the most recently written file set is read."""
    root = checkpoint_root(spark, "latest")
    a = V.articles(spark, sf_dir)
    nested = a.select("id", "type", "webTitle", "webUrl", "webPublicationDate",
                      F.struct("headline", "standfirst", "bodyText").alias("fields"))
    WR.write_table(nested, f"{root}/snap_1", fmt="json")
    en = nested.join(a.where(F.col("lang") == "en").select("id"), "id", "left_semi")
    WR.write_table(en, f"{root}/snap_2", fmt="json")
    latest = RD.latest_snapshot(spark, [f"{root}/snap_1", f"{root}/snap_2"], multiline=False, unit="dir")
    return latest.select("id", "webTitle")


@register("consensus_market_stats")
def consensus_market_stats(spark, sf_dir):
    """E1 as the reference runs it: consensus labels -> strict article dates
    -> daily mean sentiment -> joined to daily returns -> smoothing, leads,
    correlation, lagged correlation and directional accuracy."""
    prices = V.daily_prices(spark, sf_dir, min_orders=MIN_ORDERS_PER_DAY).select("symbol", "ts", "close")
    rep = PL.sentiment_market_report(consensus_labels(spark, sf_dir), prices)
    return rounded(rep.stats)


@register("consensus_market_combined")
def consensus_market_combined(spark, sf_dir):
    """E1's combined daily series (K3 content) for the consensus labels."""
    prices = V.daily_prices(spark, sf_dir, min_orders=MIN_ORDERS_PER_DAY).select("symbol", "ts", "close")
    rep = PL.sentiment_market_report(consensus_labels(spark, sf_dir), prices, lenient=True)
    return rounded(rep.combined)


@register("dashboard_range_pruned")
def dashboard_range_pruned(spark, sf_dir):
    """E3 on an explicit range (F6, A3, A20) over consensus labels stored
    month-partitioned with their date materialised at ingest: the range read
    prunes partitions."""
    root = checkpoint_root(spark, "dated-labels")
    WR.write_dated_labels(consensus_labels(spark, sf_dir), f"{root}/labels")
    lab = RD.read_dated_labels(spark, f"{root}/labels", "1995-03-01", "1995-06-30")
    return rounded(S.range_kpis(S.daily_mean(lab)))


@register("predictor_comparison")
def predictor_comparison(spark, sf_dir):
    """Both predictors evaluated on the ids they share (aligned
    by id, never by position)."""
    rep = PL.compare_predictors(V.predictions(spark, sf_dir), "rater_b", "length")
    return rounded(rep["summary"])


@register("series_csv_roundtrip")
def series_csv_roundtrip(spark, sf_dir):
    """K3: the E1 combined daily series written as CSV with its date (Q7),
    sorted by series and date (O1), read back with a typed schema."""
    root = checkpoint_root(spark, "series-csv")
    prices = V.daily_prices(spark, sf_dir, min_orders=MIN_ORDERS_PER_DAY).select("symbol", "ts", "close")
    comb = PL.sentiment_market_report(consensus_labels(spark, sf_dir), prices, lenient=True).combined
    WR.write_series_csv(comb, f"{root}/csv")
    back = spark.read.schema(comb.schema).option("header", True).csv(f"{root}/csv")
    return rounded(back)


@register("first_articles")
def first_articles(spark, sf_dir):
    """The first 100 articles in document order (a test run's batch)."""
    return PR.first_n(V.articles(spark, sf_dir), 100, "doc_id").select("id", "type")


@register("stream_daily_sentiment")
def stream_daily_sentiment(spark, sf_dir):
    """T2 on labels: consensus labels stamped with their article's
    publication time arrive as a stream; the watermarked daily mean equals
    the batch daily mean (A3) of the finished input."""
    from tidings.streaming.daily import stream_daily_from_table
    a = V.articles(spark, sf_dir).select("id", F.to_timestamp("webPublicationDate",
                                                              "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    lab = consensus_labels(spark, sf_dir).join(a.withColumnRenamed("id", "article_id"), "article_id")
    out = stream_daily_from_table(lab, "ts", "label")
    return rounded(out.select("date", "sentiment", "n_articles"))


@register("stream_daily_corrections")
def stream_daily_corrections(spark, sf_dir):
    """T2 with corrections: a first wave labels every article; a second one labels some of
    them again (the overlap of the label batches), sends others once more as they are,
    and brings outdated labels for a few. The days follow the latest labels."""
    from tidings.operators import rollup
    from tidings.streaming.corrections import run_correcting_stream
    root = checkpoint_root(spark, "corrections")
    landing, store, ck = f"{root}/landing", f"{root}/store", f"{root}/checkpoint"
    b = V.label_batches(spark, sf_dir)
    first = b.where("pos >= 0").select("article_id", "label", F.lit(1).cast("long").alias("version"))
    first.write.mode("append").parquet(landing)
    run_correcting_stream(spark, landing, store, ck)
    rollup.compact(spark, store)
    again = b.where("pos < 0").select("article_id", "label", F.lit(2).cast("long").alias("version"))
    same = first.where(F.crc32("article_id") % 5 == 0)
    late = first.where(F.crc32("article_id") % 7 == 0).withColumn("label", F.lit(4.0)).withColumn("version", F.lit(0).cast("long"))
    again.unionByName(same).unionByName(late).write.mode("append").parquet(landing)
    run_correcting_stream(spark, landing, store, ck)
    return rounded(rollup.daily(rollup.read_states(spark, store)))


@register("run_record_roundtrip")
def run_record_roundtrip(spark, sf_dir):
    """K4 + S5 (long form): two prediction modes written as a run (summary +
    mode-partitioned predictions + truth) and read back."""
    root = checkpoint_root(spark, "run")
    p = V.predictions(spark, sf_dir)
    preds = p.select(F.when(F.col("model") == "rater_b", "zero_shot").otherwise("few_shot").alias("mode"),
                     "article_id", F.col("y_pred").alias("pred"))
    truth = p.where(F.col("model") == "length").select("article_id", F.col("y_true").alias("label"))
    WR.write_run_long(preds, truth, f"{root}/run", "stand-in", "1995-01-01T00:00:00", 32)
    summary, back, _ = RD.read_run_long(spark, f"{root}/run")
    counts = back.groupBy("mode").agg(F.count(F.lit(1)).alias("n_predictions"))
    return rounded(summary.join(counts, "mode"))


@register("nested_run_record")
def nested_run_record(spark, sf_dir):
    """S5 in the reference's shape: run records (one for every 500 articles) with
    maps of predictions by mode and of the truth, written as JSON and read back."""
    root = checkpoint_root(spark, "nested-runs")
    p = V.predictions(spark, sf_dir).withColumn("k", F.floor(F.regexp_extract("article_id", r"doc-(\d+)$", 1).cast("long") / 500))
    def pairs(model, value):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("model") == model, F.struct("article_id", value)))))
    def mode(model):
        return F.struct(F.lit(0.5).alias("accuracy"), pairs(model, "y_pred").alias("predictions"))
    runs = p.groupBy("k").agg(mode("rater_b").alias("zero_shot"), mode("length").alias("few_shot"), pairs("length", "y_true").alias("ground_truth"))
    runs = runs.select(F.lit("stand-in").alias("model"), F.concat(F.lit("run-"), "k").alias("timestamp"), F.lit(32).alias("batch_size"), "zero_shot", "few_shot", "ground_truth")
    WR.write_table(runs, f"{root}/runs", fmt="json")
    preds, truth = RD.read_prediction_run(spark, f"{root}/runs", multiline=False)
    return preds.join(truth, ["run", "article_id"], "left").select("run", "mode", "article_id", "pred", "label")


@register("cost_estimate_sampled")
def cost_estimate_sampled(spark, sf_dir):
    """A22 as the reference estimates it: mean prompt tokens of the first five
    articles (file order = document order) times the article count."""
    a = PR.drop_liveblogs(V.articles(spark, sf_dir))
    return rounded(SC.cost_estimate(a, TX.sectioned_prompt(), order_col="doc_id", sample=5))
