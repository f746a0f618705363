"""Daily sentiment kept current as labelled rows arrive.

A file-source stream -> event-time watermark -> 1-day tumbling window
aggregate (``avg``, ``count``) in append mode. State holds only the open days
per group (bounded by the watermark delay), so it does not grow with history.
A day is emitted once the watermark passes its end; on a finished input that
means the input must contain a row later than the last day plus the delay
(``sentinel`` below lands one for tests and replays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.session import checkpoint_root

SENTINEL = "_sentinel"


def daily_window_agg(stream: DataFrame, ts_col: str = "ts", value_col: str = "value",
                     group_cols: list[str] | None = None, delay: str = "1 day") -> DataFrame:
    """Streaming (or batch) daily mean and count per group, keyed by the UTC day."""
    group_cols = group_cols or []
    w = stream.withWatermark(ts_col, delay)
    if SENTINEL not in stream.columns:
        g = w.groupBy(F.window(ts_col, "1 day").alias("w"), *group_cols).agg(
            F.avg(value_col).alias("sentiment"), F.count(F.lit(1)).alias("n_articles"))
        return g.select(F.to_date(F.col("w.start")).alias("date"), *group_cols, "sentiment", "n_articles")
    # The sentinel must reach the watermark node, so it is not filtered out
    # before the aggregate (Catalyst would push such a filter below the
    # watermark); it is excluded inside the aggregates instead, and groups
    # that hold only a sentinel are dropped after aggregation.
    real = ~F.col(SENTINEL)
    g = w.groupBy(F.window(ts_col, "1 day").alias("w"), *group_cols).agg(
        F.avg(F.when(real, F.col(value_col))).alias("sentiment"), F.count_if(real).alias("n_articles"))
    return g.where(F.col("n_articles") > 0).select(
        F.to_date(F.col("w.start")).alias("date"), *group_cols, "sentiment", "n_articles")


def daily_batch(df: DataFrame, ts_col: str = "ts", value_col: str = "value",
                group_cols: list[str] | None = None) -> DataFrame:
    """The batch equivalent (A3 on event time) the stream must reproduce."""
    group_cols = group_cols or []
    return df.groupBy(F.to_date(ts_col).alias("date"), *group_cols).agg(
        F.avg(value_col).alias("sentiment"), F.count(F.lit(1)).alias("n_articles"))


def run_daily_stream(spark: SparkSession, source_path: str, schema: T.StructType, output_path: str,
                     checkpoint_path: str, ts_col: str = "ts", value_col: str = "value",
                     group_cols: list[str] | None = None, delay: str = "1 day",
                     max_files_per_trigger: int | None = None) -> None:
    """Process everything available in ``source_path`` (``availableNow``) and
    append finished days to Parquet at ``output_path``. Restartable: the
    checkpoint records consumed files and open-window state, so a rerun (or a
    lost executor) neither drops nor double-counts rows."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    agg = daily_window_agg(stream, ts_col, value_col, group_cols, delay)
    q = (agg.writeStream.outputMode("append").format("parquet")
            .option("path", output_path).option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def land_with_sentinel(df: DataFrame, landing: str, ts_col: str = "ts", sentinel_ts: str = "9999-12-30 00:00:00"):
    """Append ``df`` to a landing folder plus one sentinel row at
    ``sentinel_ts`` (flagged ``_sentinel``), so that the watermark passes every
    real day before it. The flag keeps the sentinel out of the aggregates."""
    df.withColumn(SENTINEL, F.lit(False)).write.mode("append").parquet(landing)
    spark = df.sparkSession
    row = spark.range(1).select(*[(F.lit(sentinel_ts).cast("timestamp") if f.name == ts_col else F.lit(None))
                                  .cast(f.dataType).alias(f.name) for f in df.schema.fields],
                                F.lit(True).alias(SENTINEL))
    row.write.mode("append").parquet(landing)


def stream_daily_from_table(df: DataFrame, ts_col: str = "ts", value_col: str = "value",
                            group_cols: list[str] | None = None, delay: str = "1 day") -> DataFrame:
    """Land ``df`` in the shared checkpoint folder, run the stream to the end
    and return the emitted days (read back from the sink).

    This turns a finished batch table into stream input for checks and
    replays; it copies the table once. In production the stream reads the
    folder where new label files land (:func:`run_daily_stream`), with no copy.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark, "daily-stream")
    landing, out, ck = f"{root}/landing", f"{root}/out", f"{root}/checkpoint"
    # event time must be a TIMESTAMP (an NTZ column is read as UTC wall time)
    cols = [F.col(ts_col).cast("timestamp").alias(ts_col), value_col] + list(group_cols or [])
    land_with_sentinel(df.select(*cols), landing, ts_col)
    schema = spark.read.parquet(landing).schema
    run_daily_stream(spark, landing, schema, out, ck, ts_col, value_col, group_cols, delay)
    return spark.read.parquet(out)
