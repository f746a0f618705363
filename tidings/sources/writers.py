"""Sinks (K1-K5). Every writer is a distributed DataFrame write; nothing is
gathered on the driver. Small, bounded reports (K4 maps of a 10-article run,
K5 summary) are still written by Spark, as one JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """K1: articles / labels as Parquet (default) or JSON lines. Spark writes JSON as it
    is unless a ``compression`` is named; readers tell it by the files' names."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def write_by_type(articles: DataFrame, path: str, type_col: str = "type", fmt: str = "json") -> None:
    """K2: one folder per article type (missing type -> 'unknown')."""
    a = articles.withColumn(type_col, F.coalesce(F.col(type_col), F.lit("unknown")))
    a.write.mode("overwrite").partitionBy(type_col).format(fmt).save(path)


def write_series_csv(combined: DataFrame, path: str) -> None:
    """K3: combined series as CSV with header; the date is kept (Q7)."""
    combined.orderBy("series", "date").write.mode("overwrite").option("header", True).csv(path)


#: Predictions that one nested run record may hold.
RUN_RECORD_ROWS = 100_000


def run_record(preds: DataFrame, truth: DataFrame, model: str, timestamp: str, batch_size: int) -> DataFrame:
    """K4: ``{model, timestamp, batch_size, <mode>{accuracy, predictions},
    ground_truth}`` as one row, for runs of at most ``RUN_RECORD_ROWS`` predictions
    (larger ones raise: :func:`write_run_long` writes them without gathering a run
    into one row)."""
    n = preds.count()
    if n > RUN_RECORD_ROWS:
        raise ValueError(f"{n} predictions are too many for one record; use write_run_long")
    j = preds.join(truth.select("article_id", F.col("label").alias("_y")), "article_id", "inner")
    per_mode = j.groupBy("mode").agg(
        F.avg((F.col("pred") == F.col("_y")).cast("double")).alias("accuracy"),
        F.map_from_entries(F.collect_list(F.struct("article_id", "pred"))).alias("predictions"))
    modes = per_mode.agg(F.map_from_entries(F.collect_list(
        F.struct("mode", F.struct("accuracy", "predictions")))).alias("m"))
    gt = truth.agg(F.map_from_entries(F.collect_list(F.struct("article_id", F.col("label").cast("int"))))).scalar()
    j2 = modes.withColumn("ground_truth", gt)
    return j2.select(F.lit(model).alias("model"), F.lit(timestamp).alias("timestamp"),
                     F.lit(batch_size).alias("batch_size"),
                     F.col("m")["zero_shot"].alias("zero_shot"), F.col("m")["few_shot"].alias("few_shot"),
                     "ground_truth")


def write_json_report(df: DataFrame, path: str) -> None:
    """K4 / K5: a report DataFrame (an aggregate: a handful of rows) as JSON.
    No forced single task - AQE coalesces the few post-aggregation partitions."""
    df.write.mode("overwrite").json(path)


def write_bucketed(df: DataFrame, table_name: str, path: str, key: str = "article_id", buckets: int = 256,
                   mode: str = "overwrite") -> None:
    """Write ``df`` as a Parquet table bucketed and sorted by ``key``. Two
    tables bucketed the same way (articles and labels by id) join without a
    shuffle of either side - the co-located form for repeated id joins."""
    (df.write.mode(mode).format("parquet").option("path", path)
       .bucketBy(buckets, key).sortBy(key).saveAsTable(table_name))


def write_in_order(df: DataFrame, path: str, order_cols: list[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Write ``df`` sorted by ``order_cols`` over files that follow each other by name
    (ranges of the order, sorted inside), as :mod:`tidings.sources.positions` reads them.
    The one sort of the table, when it is written. ``files``: how many (default: by size)."""
    keys = [F.col(c).asc_nulls_first() for c in order_cols]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def write_dated_labels(labels: DataFrame, path: str, id_col: str = "article_id", lenient: bool = False,
                       mode: str = "overwrite") -> None:
    """Materialise the article date (P1/P2) at ingest and write the labels
    partitioned by month: later date-range reads (F6, E3) prune whole
    partitions instead of re-parsing every id. Undated labels go to the
    default (null) partition."""
    from tidings.functions import dates
    d = labels.withColumn("date", dates.article_date(id_col, lenient))
    d = d.withColumn("month", F.date_format("date", "yyyy-MM"))
    d.write.mode(mode).partitionBy("month").parquet(path)


def write_run_long(preds: DataFrame, truth: DataFrame, path: str, model: str, timestamp: str,
                   batch_size: int) -> None:
    """K4 at scale: the same run record without gathering a run into one row.
    ``<path>/summary``: one row per mode (model, timestamp, batch size,
    accuracy, n) from one aggregate; ``<path>/predictions``: the long
    ``(mode, article_id, pred)`` table partitioned by mode;
    ``<path>/truth``: ``(article_id, label)``."""
    j = preds.join(truth.select("article_id", F.col("label").alias("_y")), "article_id", "inner")
    summary = j.groupBy("mode").agg(F.avg((F.col("pred") == F.col("_y")).cast("double")).alias("accuracy"),
                                    F.count(F.lit(1)).alias("n"))
    summary = summary.select(F.lit(model).alias("model"), F.lit(timestamp).alias("timestamp"),
                             F.lit(batch_size).alias("batch_size"), "mode", "accuracy", "n")
    write_json_report(summary, f"{path}/summary")
    preds.select("mode", "article_id", "pred").write.mode("overwrite").partitionBy("mode").parquet(f"{path}/predictions")
    truth.select("article_id", "label").write.mode("overwrite").parquet(f"{path}/truth")
