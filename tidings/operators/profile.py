"""Article profiling (A1, A2, A28, K5 totals, F1-F4 filters, J1/J5 joins).

Statistics are hash aggregates per article type. A dominant type (a third of
all rows) is fine: ``count/min/max/avg`` are combined map-side, so only one
partial row per type and task crosses the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions import dates, text
from tidings.session import stage


def with_defaults(articles: DataFrame, type_col: str = "type", id_col: str = "id") -> DataFrame:
    """Missing type / id -> 'unknown'."""
    return (articles.withColumn(type_col, text.default_text(type_col))
                    .withColumn(id_col, text.default_text(id_col)))


def type_counts(articles: DataFrame, type_col: str = "type") -> DataFrame:
    """A1: article count per type (missing type -> 'unknown')."""
    return articles.groupBy(text.default_text(type_col).alias("type")).agg(F.count(F.lit(1)).alias("count"))


def _stats_input(articles: DataFrame, type_col: str) -> DataFrame:
    """Day and word count computed once per article, below the aggregate (and
    below a rollup's Expand, which would otherwise copy the body text and
    split it once per grouping set)."""
    return articles.select(text.default_text(type_col).alias("_type"),
                           dates.publication_day("webPublicationDate").alias("_day"),
                           text.word_count("bodyText").alias("_words"))  # NULL when the body is missing


def _stats_aggs():
    day, words = F.col("_day"), F.col("_words")
    return [F.count(F.lit(1)).alias("count"),
            F.min(day).alias("min_date"), F.max(day).alias("max_date"),
            F.coalesce(F.avg(words), F.lit(0.0)).alias("avg_word_count"),
            F.coalesce(F.min(words), F.lit(0)).cast("long").alias("min_word_count"),
            F.coalesce(F.max(words), F.lit(0)).cast("long").alias("max_word_count")]


def type_statistics(articles: DataFrame, type_col: str = "type") -> DataFrame:
    """A2: per type count, first / last publication day, and word statistics
    over rows that have a body (none -> 0; no date -> NULL for "N/A")."""
    return _stats_input(articles, type_col).groupBy(F.col("_type").alias("type")).agg(*_stats_aggs())


def type_statistics_with_total(articles: DataFrame, type_col: str = "type") -> DataFrame:
    """K5: per-type statistics plus an ``all`` total row, in one ``rollup``."""
    a = _stats_input(articles, type_col)
    r = a.rollup("_type").agg(*_stats_aggs(), F.grouping("_type").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("_type")).alias("type"),
                    "count", "min_date", "max_date", "avg_word_count", "min_word_count", "max_word_count")


def data_check(articles: DataFrame, body_col: str = "bodyText", id_col: str = "id") -> DataFrame:
    """Total articles, how many have a body, that share, and one sample
    article id (the smallest, so the sample is deterministic)."""
    return articles.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col(body_col).isNotNull()).alias("with_body"),
                        F.try_divide(F.count_if(F.col(body_col).isNotNull()).cast("double"),
                                     F.count(F.lit(1))).alias("body_share"),
                        F.min(id_col).alias("sample_id"))


def drop_liveblogs(articles: DataFrame, type_col: str = "type") -> DataFrame:
    """null-safe - rows without a type stay."""
    return articles.where(~F.col(type_col).eqNullSafe("liveblog"))


def labelled(articles: DataFrame, labels: DataFrame, id_col: str = "id", label_id: str = "article_id") -> DataFrame:
    """Inner join of articles to labels on the id (AQE picks a
    broadcast when the label side is measured small, sort-merge otherwise)."""
    lab = labels.withColumnRenamed(label_id, id_col) if label_id != id_col else labels
    return articles.join(lab, id_col, "inner")


def excluding(articles: DataFrame, ids: DataFrame, id_col: str = "id", other_id: str = "article_id") -> DataFrame:
    """Left anti join on the id."""
    ex = ids.select(F.col(other_id).alias(id_col))
    return articles.join(ex, id_col, "left_anti")


def prepare_dataset(articles: DataFrame, labels: DataFrame, exclude: DataFrame | None = None,
                    id_col: str = "id", prefix: int | None = None, prompt_text: Column | None = None) -> DataFrame:
    """F1 + F2 + F3 + P5: labelled, non-liveblog articles with their prompt
    text ``(id, type, webTitle, text, label...)``. ``prefix`` cuts the body to
    so many code points; without it the text is whole."""
    a = drop_liveblogs(articles)
    keep = [c for c in (id_col, "type", "webTitle") if c in a.columns]
    a = a.select(*keep, (text.title_body(n=prefix) if prompt_text is None else prompt_text).alias("text"))
    if exclude is not None:
        a = excluding(a, exclude, id_col)
    return labelled(a, labels, id_col)


def newest(articles: DataFrame, n: int, date_col: str = "webPublicationDate") -> DataFrame:
    """O3: the ``n`` newest articles (a top-k: TakeOrderedAndProject keeps only
    ``n`` rows per task before the final merge)."""
    return articles.orderBy(F.col(date_col).desc(), F.col("id").desc()).limit(n)


def with_row_index(df: DataFrame, order_cols: str | list[str], index_col: str = "idx",
                   group_cols: list[str] | None = None) -> DataFrame:
    """A stable 0-based position of every row in ``order_cols`` order (within
    each group of ``group_cols``), without a window over all rows or a group.

    Rows are range-partitioned by group and order columns (hot values included:
    later order columns split them) and sorted there; a row's position is its
    place in its range plus the rows of its group in the ranges before, which are
    counted once (a table of one row per range and group it holds). The sorted
    ranges are staged, since range bounds are sampled anew by every run of a plan.
    Rows equal in all order columns share a range and may swap positions.
    """
    from pyspark.sql import Window
    groups = list(group_cols or [])
    keys = groups + ([order_cols] if isinstance(order_cols, str) else list(order_cols))
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    ranged = stage(ranged.withColumn("_range", F.spark_partition_id())
                         .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "row-index")
    counts = ranged.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *[F.col(g).alias(f"_{g}") for g in groups], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = ranged["_range"] == offsets["_range"]
    for g in groups:
        same = same & ranged[g].eqNullSafe(offsets[f"_{g}"])
    out = ranged.join(offsets, same, "left")
    return out.select(*[ranged[c] for c in df.columns if c != index_col], (F.col("_off") + F.col("_at") - F.col("_first")).cast("long").alias(index_col))


def index_range(df: DataFrame, start: int, count: int, order_cols: str | list[str], index_col: str = "idx") -> DataFrame:
    """rows at positions ``[start, start + count)`` (clipped to the data)."""
    start = max(0, start)
    return with_row_index(df, order_cols, index_col).where(
        (F.col(index_col) >= start) & (F.col(index_col) < start + max(0, count)))


def text_dataset(articles: DataFrame, labels: DataFrame, id_col: str = "id", label_id: str = "article_id",
                 label_col: str = "label") -> DataFrame:
    """P4 + F4 + P24 + J1: labelled articles with the stripped
    headline/standfirst/body text; rows whose text is empty are dropped and
    labels truncated to int (the fine-tuning dataset)."""
    # one text column instead of three parts crosses the exchange, and only of rows that have text
    t = articles.where(F.col(id_col).isNotNull()).select(id_col, text.trimmed_text().alias("text")).where(F.col("text") != "")
    return labelled(t, labels, id_col, label_id).select(id_col, "text", F.col(label_col).cast("int").alias(label_col))


def first_n(df: DataFrame, n: int, *order_cols) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (a top-k)."""
    return df.orderBy(*order_cols).limit(n)
