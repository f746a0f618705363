"""Daily sentiment and market series.

Every window here is partitioned by the series key(s). Raw article or tick
rows are first reduced to one row per (series, day) by a partially-aggregated
``groupBy`` - so a window task holds at most one series' days, a bound that
does not grow with the number of articles (SURVEY 4.3 rule 6). A
single-series call uses a constant key; that is one task over daily rows
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.parse import direction
from tidings.operators.metrics import safe_corr

ROLLING = 5
LAGS = (1, 2, 3, 4, 5)
SENTIMENT_PIVOT = 2.0


def _keys(series_cols) -> list[str]:
    if series_cols is None:
        return []
    return [series_cols] if isinstance(series_cols, str) else list(series_cols)


def daily_mean(labels: DataFrame, date_col: str = "date", value_col: str = "label",
               series_cols=None) -> DataFrame:
    """A3: mean label and article count per (series, day); rows without a date
    are dropped (F5)."""
    keys = _keys(series_cols)
    return (labels.where(F.col(date_col).isNotNull())
            .groupBy(*keys, F.col(date_col).alias("date"))
            .agg(F.avg(value_col).alias("sentiment"), F.count(F.lit(1)).alias("n_articles")))


def daily_close(ticks: DataFrame, ts_col: str = "ts", close_col: str = "close", symbol_col: str = "symbol") -> DataFrame:
    """Reduce any price rows to one per (symbol, UTC day): the last close of the
    day. An aggregate (``max_by``), so a heavily traded symbol is combined
    map-side before the shuffle."""
    return ticks.groupBy(symbol_col, F.to_date(ts_col).alias("date")).agg(
        F.max_by(F.col(close_col), F.col(ts_col)).alias(close_col), F.max(ts_col).alias(ts_col))


def daily_returns(prices: DataFrame, ts_col: str = "ts", close_col: str = "close",
                  symbol_col: str = "symbol", fill_gaps: bool = True) -> DataFrame:
    """``return = close / previous close - 1`` in time order per symbol,
    missing closes forward-filled first (pandas ``pct_change`` default, Q8).
    Output ``(symbol, date, close, return)`` with ``date`` the UTC day."""
    w = Window.partitionBy(symbol_col).orderBy(ts_col)
    filled = F.last(close_col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) \
        if fill_gaps else F.col(close_col)
    p = prices.select(symbol_col, ts_col, close_col, filled.alias("_filled"))
    prev = F.lag("_filled", 1).over(w)
    ret = F.try_divide(F.col("_filled"), prev) - F.lit(1.0)
    return p.select(symbol_col, F.to_date(ts_col).alias("date"), close_col, ret.alias("return"))


def price_range(prices: DataFrame, start=None, end=None, period_days: int | None = None,
                date_col: str = "date", symbol_col: str = "symbol") -> DataFrame:
    """``[start, end)`` slice (end exclusive), or the trailing ``period_days``
    per symbol (``date > max_date - period``)."""
    if period_days is not None:
        mx = prices.groupBy(symbol_col).agg(F.max(date_col).alias("_max"))
        return (prices.join(mx, symbol_col)
                .where(F.col(date_col) > F.date_sub("_max", period_days)).drop("_max"))
    c = F.lit(True)
    if start is not None:
        c = c & (F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        c = c & (F.col(date_col) < F.lit(end).cast("date"))
    return prices.where(c)


def rolling_mean(col: str, w: Window, n: int = ROLLING) -> Column:
    """Mean of the last ``n`` rows, NULL until ``n`` non-null values are in
    the frame (pandas ``rolling(n).mean()``)."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


def combine(sentiment: DataFrame, returns: DataFrame, series_cols=None, on_symbol: str | None = None,
            rolling: int = ROLLING, lags=LAGS) -> DataFrame:
    """J3 + W2 + W3 + P21: the combined daily series.

    ``sentiment``: ``(series..., date, sentiment, n_articles)``; ``returns``:
    ``(symbol, date, return)``. With ``on_symbol`` the series key of the
    sentiment equals that symbol column; otherwise one sentiment series is
    joined to every symbol (``symbol`` is kept as the series key). Leads count
    joined rows, not calendar days (Q9). One window pass per series.
    """
    keys = _keys(series_cols)
    r = returns.select(F.col("symbol"), "date", "return")
    if on_symbol:
        s = sentiment.withColumnRenamed(keys[0], "symbol") if keys else sentiment
        j = s.join(r, ["symbol", "date"], "inner")
    else:
        s = sentiment.drop(*keys)
        j = s.join(r, ["date"], "inner")
    w = Window.partitionBy("symbol").orderBy("date")
    cols = [F.col("symbol").alias("series"), "date", "sentiment", "n_articles", "return",
            rolling_mean("return", w, rolling).alias("return_smoothed"),
            rolling_mean("sentiment", w, rolling).alias("sentiment_smoothed")]
    cols += [F.lead("return", k).over(w).alias(f"return_lead{k}") for k in lags]
    out = j.select(*cols)
    out = out.withColumn("next_return", F.col("return_lead1")) if 1 in lags else \
        out.withColumn("next_return", F.lead("return", 1).over(w))
    return (out.withColumn("sentiment_dir", direction("sentiment", SENTIMENT_PIVOT))
               .withColumn("return_dir", direction("next_return", 0.0)))


def combine_prices(sentiment: DataFrame, prices: DataFrame, series_col: str | None = "series",
                   rolling: int = ROLLING, lags=LAGS, fill_gaps: bool = True, align: str = "joined") -> DataFrame:
    """W1 + J3 + W2 + W3 + P21 in one partitioned pass: same output as
    ``combine(sentiment, daily_returns(prices), series_col, on_symbol=...)``.

    ``prices``: one row per ``(symbol, date)`` with ``close`` (aggregated by
    exactly these keys, so the join below needs no further exchange). The
    daily prices are left-joined with the sentiment days; one window pass per
    symbol computes the (gap-filled) return over every price day, the rows
    without sentiment are dropped (the reference's inner join), and a second
    window with the same partitioning computes smoothing and leads over the
    joined days - no shuffle between the two. With ``series_col=None`` one
    sentiment series (keyed by date only) is joined to every symbol.

    ``align="joined"`` (default) smooths and shifts over the joined days only,
    like the reference (Q9: days without articles vanish). ``align="trading"``
    smooths and shifts over every price day and keeps the days with
    sentiment afterwards, so ``lead(1)`` is the next trading day's return even
    when that day had no articles.
    """
    if align not in ("joined", "trading"):
        raise ValueError("align must be 'joined' or 'trading'")
    if series_col:
        s = sentiment.withColumnRenamed(series_col, "symbol")
        j = prices.select("symbol", "date", "close").join(s, ["symbol", "date"], "left")
    else:
        j = prices.select("symbol", "date", "close").join(sentiment, ["date"], "left")
    w = Window.partitionBy("symbol").orderBy("date")
    filled = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) \
        if fill_gaps else F.col("close")
    j = j.withColumn("_filled", filled)
    j = j.withColumn("return", F.try_divide(F.col("_filled"), F.lag("_filled", 1).over(w)) - F.lit(1.0))
    matched = F.col("n_articles").isNotNull()  # a sentiment day (count >= 1)
    if align == "joined":
        j = j.where(matched)
    cols = [F.col("symbol").alias("series"), "date", "sentiment", "n_articles", "return",
            rolling_mean("return", w, rolling).alias("return_smoothed"),
            rolling_mean("sentiment", w, rolling).alias("sentiment_smoothed")]
    cols += [F.lead("return", k).over(w).alias(f"return_lead{k}") for k in lags]
    out = j.select(*cols)
    out = out.withColumn("next_return", F.col("return_lead1")) if 1 in lags else \
        out.withColumn("next_return", F.lead("return", 1).over(w))
    if align == "trading":  # after the windows: a filter on a non-key column is not pushed below them
        out = out.where(F.col("n_articles").isNotNull())
    return (out.withColumn("sentiment_dir", direction("sentiment", SENTIMENT_PIVOT))
               .withColumn("return_dir", direction("next_return", 0.0)))


def market_stats(combined: DataFrame, lags=LAGS) -> DataFrame:
    """A17 + A18 + A19 in a single aggregate per series: correlation raw and
    smoothed, lagged correlations, directional accuracy and its day count."""
    both = (F.col("sentiment_dir") != 0) & (F.col("return_dir") != 0)
    aggs = [F.count(F.lit(1)).alias("n_days"),
            safe_corr("sentiment", "return").alias("corr"),
            safe_corr("sentiment_smoothed", "return_smoothed").alias("corr_smoothed")]
    aggs += [safe_corr("sentiment", f"return_lead{k}").alias(f"corr_lag{k}") for k in lags]
    aggs += [F.avg(F.when(both, (F.col("sentiment_dir") == F.col("return_dir")).cast("double")))
             .alias("dir_accuracy"),
             F.count_if(both).alias("dir_days")]
    return combined.groupBy("series").agg(*aggs)


def lag_correlations(combined: DataFrame, lags=LAGS) -> DataFrame:
    """A18 as a long table ``(series, lag, corr)``; lag 0 is the plain correlation."""
    stats = combined.groupBy("series").agg(
        safe_corr("sentiment", "return").alias("lag0"),
        *[safe_corr("sentiment", f"return_lead{k}").alias(f"lag{k}") for k in lags])
    names = ["lag0"] + [f"lag{k}" for k in lags]
    long = stats.unpivot(["series"], names, "lag_name", "corr")
    return long.select("series", F.regexp_extract("lag_name", r"(\d+)", 1).cast("int").alias("lag"), "corr")


def data_range(daily: DataFrame, default_days: int = 30, series_cols=None) -> DataFrame:
    """First / last day and the default range start
    ``max(first, last - default_days)``."""
    keys = _keys(series_cols)
    g = daily.groupBy(*keys).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    return g.withColumn("default_start", F.greatest("min_date", F.date_sub("max_date", default_days)))


def range_kpis(daily: DataFrame, start=None, end=None, series_cols=None) -> DataFrame:
    """A20 on an inclusive day range (F6): mean / min / max of the daily means
    (Q13), article-weighted mean beside it, article total and day count."""
    keys = _keys(series_cols)
    d = daily
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start).cast("date") if not isinstance(start, Column) else
                    F.col("date") >= start)
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end).cast("date") if not isinstance(end, Column) else
                    F.col("date") <= end)
    return d.groupBy(*keys).agg(
        F.avg("sentiment").alias("mean_sentiment"), F.min("sentiment").alias("min_sentiment"),
        F.max("sentiment").alias("max_sentiment"),
        F.try_divide(F.sum(F.col("sentiment") * F.col("n_articles")), F.sum("n_articles")).alias("article_mean"),
        F.sum("n_articles").alias("n_articles"), F.count(F.lit(1)).alias("n_days"))


def default_range_kpis(daily: DataFrame, default_days: int = 30, series_cols=None) -> DataFrame:
    """E3 core: KPIs over the default range ``[max(min, max-30d), max]``.

    The daily rows are made once: they are gathered per series beside the series' first
    and last day, and the days of the range are unfolded from there. A list
    holds one entry a day, so it is bounded by the calendar, not by the labels."""
    keys = _keys(series_cols)
    whole = daily.groupBy(*keys).agg(F.min("date").alias("_first"), F.max("date").alias("range_end"),
                                     F.collect_list(F.struct("date", "sentiment", "n_articles")).alias("_days"))
    whole = whole.withColumn("range_start", F.greatest("_first", F.date_sub("range_end", default_days)))
    d = whole.select(*keys, "range_start", "range_end", F.inline(F.filter("_days", lambda x: x["date"] >= F.col("range_start"))))
    return d.groupBy(*keys, "range_start", "range_end").agg(
        F.avg("sentiment").alias("mean_sentiment"), F.min("sentiment").alias("min_sentiment"),
        F.max("sentiment").alias("max_sentiment"),
        F.try_divide(F.sum(F.col("sentiment") * F.col("n_articles")), F.sum("n_articles")).alias("article_mean"),
        F.sum("n_articles").alias("n_articles"), F.count(F.lit(1)).alias("n_days"))
