"""Fixture views over the driver tables.

The driver's tables hold no news articles, rater labels or prices, so these
views derive them deterministically from ``documents``, ``lineitem``,
``orders``, ``customer`` and ``events``. Every derivation is a projection or
an aggregate over the whole table, so the work grows with the data. The same
definitions, written for DuckDB, live in :mod:`tidings.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar the derived articles are spread over: two years (like the
# reference's 730-day collection window) inside the order calendar, so that
# article sentiment and order-derived prices share trading days.
ARTICLE_EPOCH = "1995-01-01"
ARTICLE_DAYS = 731
# Width of one derived label batch file, and how many trailing ids of each
# batch are labelled again by the next batch.
BATCH_WIDTH = 100
BATCH_OVERLAP = 30


_TABLES: dict = {}


def _memo(fn):
    """Build each fixture view's (lazy) DataFrame once per session and input."""
    cache: dict = {}

    def wrapper(spark, sf_dir, *args, **kwargs):
        key = (id(spark), sf_dir, args, tuple(sorted(kwargs.items())))
        df = cache.get(key)
        if df is None or df.sparkSession is not spark:
            df = cache[key] = fn(spark, sf_dir, *args, **kwargs)
        return df
    wrapper.__doc__, wrapper.__name__ = fn.__doc__, fn.__name__
    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the DataFrame (file listing, footer schema) is built
    once per session and path - the tables are read-only inputs."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


@_memo
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat article rows derived from ``documents``.

    id: ``business/[article/]yyyy/mon/dd/doc-<doc_id>`` (every fifth id has the
    extra ``article`` segment the strict date rule drops, Q1); type: liveblog /
    missing / article; headline: first line of the text; body missing for
    every thirteenth document.
    """
    d = table(spark, sf_dir, "documents")
    pub_date = F.date_add(F.lit(ARTICLE_EPOCH).cast("date"), (F.col("doc_id") % ARTICLE_DAYS).cast("int"))
    pub_ts = F.timestamp_seconds(F.unix_timestamp(pub_date.cast("timestamp")) + (F.col("doc_id") * 37) % 86400)
    art_id = F.concat(
        F.lit("business/"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("article/")).otherwise(F.lit("")),
        F.lower(F.date_format(pub_date, "yyyy/MMM/dd")),
        F.lit("/doc-"), F.col("doc_id").cast("string"))
    headline = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return d.select(
        "doc_id",
        art_id.alias("id"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("liveblog"))
         .when(F.col("doc_id") % 10 == 1, F.lit(None).cast("string"))
         .otherwise(F.lit("article")).alias("type"),
        headline.alias("webTitle"),
        F.concat(F.lit("https://news.example.com/"), art_id).alias("webUrl"),
        F.date_format(pub_ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("webPublicationDate"),
        headline.alias("headline"),
        F.concat(F.lit("<p>"), F.col("source"), F.lit("</p>")).alias("standfirst"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("bodyText"),
        "lang", "source", "n_chars",
    )


@_memo
def rater_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long label table ``(article_id, rater, label)`` of two raters.

    Rater ``a`` reads every language but Spanish, rater ``b`` every language but
    German, so the full outer merge has both-sides, a-only and b-only ids.
    """
    a = articles(spark, sf_dir).select("id", "doc_id", "n_chars", "lang")
    la = a.where(F.col("lang") != "es").select(
        F.col("id").alias("article_id"), F.lit("a").alias("rater"),
        ((F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("double").alias("label"))
    lb = a.where(F.col("lang") != "de").select(
        F.col("id").alias("article_id"), F.lit("b").alias("rater"),
        ((F.col("doc_id") * 3 + F.col("n_chars")) % 5).cast("double").alias("label"))
    return la.unionByName(lb)


@_memo
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rater ``b``'s labels cut into batch files ``labels_<start>to<end>``.

    The last ``BATCH_OVERLAP`` ids of each batch are labelled again by the
    next batch with the label shifted by one. Columns:
    ``(article_id, label, src_file, pos)``.
    """
    a = articles(spark, sf_dir).select("id", "doc_id", "n_chars")
    base = (F.col("doc_id") * 3 + F.col("n_chars")) % 5
    start = F.floor(F.col("doc_id") / BATCH_WIDTH) * BATCH_WIDTH

    def fname(s):
        return F.concat(F.lit("labels_"), s.cast("string"), F.lit("to"), (s + BATCH_WIDTH).cast("string"))

    pos = (F.col("doc_id") - start).cast("int")  # position inside its own batch file
    own = a.select(F.col("id").alias("article_id"), base.cast("double").alias("label"),
                   fname(start).alias("src_file"), pos.alias("pos"))
    # the trailing positions of every batch are labelled again by the next batch
    again = a.where(pos >= BATCH_WIDTH - BATCH_OVERLAP).select(
        F.col("id").alias("article_id"), ((base + 1) % 5).cast("double").alias("label"),
        fname(start + BATCH_WIDTH).alias("src_file"), (pos - BATCH_WIDTH).alias("pos"))
    return own.unionByName(again)


@_memo
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table ``(model, article_id, y_true, y_pred)``.

    Truth is rater ``a``; model ``rater_b`` predicts rater ``b``'s label with an
    unparseable answer (-1) on every seventeenth document; model ``length``
    predicts from the text length. Each leaves out some ids (every eleventh, every
    thirteenth), since predictors are to be aligned by id.
    """
    a = articles(spark, sf_dir)
    both = a.where(F.col("doc_id") % 11 != 3)
    truth = ((F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int")
    rb = both.select(F.lit("rater_b").alias("model"), F.col("id").alias("article_id"),
                     truth.alias("y_true"),
                     F.when(F.col("doc_id") % 17 == 0, F.lit(-1))
                      .otherwise(((F.col("doc_id") * 3 + F.col("n_chars")) % 5).cast("int")).alias("y_pred"))
    ln = a.where(F.col("doc_id") % 13 != 5).select(
        F.lit("length").alias("model"), F.col("id").alias("article_id"), truth.alias("y_true"),
        F.least(F.floor(F.log10(F.col("n_chars") + 1)), F.lit(4)).cast("int").alias("y_pred"))
    return rb.unionByName(ln)


@_memo
def daily_signal(spark: SparkSession, sf_dir: str, by_segment: bool = False) -> DataFrame:
    """Daily 'sentiment' series from ``lineitem``: mean of ``l_linenumber % 5``
    per ship day -> ``(series, date, sentiment, n_articles)``."""
    li = table(spark, sf_dir, "lineitem")
    if by_segment:
        seg = segment_of_orders(spark, sf_dir)
        li = li.join(seg, li.l_orderkey == seg.o_orderkey, "inner").withColumnRenamed("c_mktsegment", "series")
    else:
        li = li.withColumn("series", F.lit("all"))
    return li.groupBy("series", F.to_date("l_shipdate").alias("date")).agg(
        F.avg(F.col("l_linenumber") % 5).alias("sentiment"), F.count(F.lit(1)).alias("n_articles"))


@_memo
def orders_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the customer's market segment. Both segment series
    (prices and the lineitem signal) use this one subplan, so Spark computes
    the orders x customer join once and reuses its exchange."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        "o_orderkey", "o_orderdate", "o_totalprice", "c_mktsegment")


def segment_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_segment(spark, sf_dir).select("o_orderkey", "c_mktsegment")


@_memo
def daily_prices(spark: SparkSession, sf_dir: str, by_segment: bool = False, min_orders: int = 1) -> DataFrame:
    """Daily 'close' from ``orders``: mean ``o_totalprice`` per order day
    -> ``(symbol, date, ts, close)``, one row per symbol and day. Days with
    fewer than ``min_orders`` orders are kept as gaps (close NULL)."""
    if by_segment:
        o = orders_with_segment(spark, sf_dir).withColumnRenamed("c_mktsegment", "symbol")
    else:
        o = table(spark, sf_dir, "orders").withColumn("symbol", F.lit("all"))
    g = o.groupBy("symbol", F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("ts"))
    return g.select("symbol", "date", "ts", F.when(F.col("n") >= min_orders, F.col("close")).alias("close"))
