"""Incremental, resumable labelling of newly landed articles.

A file-source stream of articles is reduced to ids the stream has not seen yet
(stream state, partitioned by id: a micro-batch touches only its own ids, however
many have been labelled), filtered (F1), scored with the pluggable scorer (M5)
and written to ``<results>/attempt=0/batch=<batch id>``, which the batch
replaces as a whole. A crash or a lost executor re-runs the unfinished
micro-batch with the same state and overwrites its folder, so no article gets two rows.

Rows whose call failed are kept apart by ``status`` and labelled again by
:func:`retry_failed`, which writes the next ``attempt``; :func:`latest_labels` is
the table with the last attempt of every id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions import text
from tidings.operators import profile, scoring
from tidings.sources.readers import ARTICLE, flatten_articles

Factory = Callable[[], Callable[[list[str]], list[str]]]

RESULT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("raw_response", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("label", T.IntegerType()), T.StructField("scored_at", T.TimestampType())])


def results_table(spark: SparkSession, results_path: str) -> DataFrame | None:
    """All attempts, or None before the first one. Only the absence of the folder
    means that; any other error of the storage is raised."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(results_path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    schema = T.StructType(RESULT.fields + [T.StructField("attempt", T.IntegerType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(results_path)


def latest_labels(spark: SparkSession, results_path: str) -> DataFrame:
    """One row per id: its last attempt."""
    rows = results_table(spark, results_path)
    if rows is None:
        return spark.createDataFrame([], RESULT)
    last = rows.groupBy(F.col("id").alias("_id")).agg(F.max("attempt").alias("_last"))
    same = (F.col("id") == F.col("_id")) & (F.col("attempt") == F.col("_last"))
    return rows.join(last, same, "left_semi").select(*RESULT.fieldNames())


def _write(todo: DataFrame, folder: str, scorer_factory: Factory, batch_size: int) -> None:
    prompts = todo.withColumn("text", text.simple_prompt())
    scored = scoring.with_label(scoring.score_texts(prompts, scorer_factory, "id", "text", batch_size))
    scored.withColumn("scored_at", F.current_timestamp()).select(*RESULT.fieldNames()).write.mode("overwrite").parquet(folder)


def run_labelling_stream(spark: SparkSession, source_path: str, results_path: str, checkpoint_path: str,
                         scorer_factory: Factory, fmt: str = "parquet", schema: T.StructType | None = None,
                         max_files_per_trigger: int | None = None, batch_size: int = scoring.BATCH_SIZE) -> None:
    """Label everything available in ``source_path`` once (``availableNow``).
    Ids sent again are not labelled again. For very many ids set the session's
    ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB store."""
    reader = spark.readStream.schema(schema or ARTICLE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        stream = flatten_articles(reader.option("multiLine", True).json(source_path))
    else:
        stream = reader.parquet(source_path)
    todo = profile.drop_liveblogs(stream).where(F.col("id").isNotNull()).dropDuplicates(["id"])

    def label(batch: DataFrame, batch_id: int) -> None:
        _write(batch, f"{results_path}/attempt=0/batch={batch_id}", scorer_factory, batch_size)

    q = (todo.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def retry_failed(spark: SparkSession, articles: DataFrame, results_path: str, scorer_factory: Factory,
                 batch_size: int = scoring.BATCH_SIZE) -> int:
    """Label the articles whose last attempt failed once more; the number of the attempt."""
    rows = results_table(spark, results_path)
    if rows is None:
        return 0
    failed = latest_labels(spark, results_path).where("status <> 'ok'").select(F.col("id").alias("_id"))
    attempt = rows.agg(F.max("attempt")).first()[0] + 1
    todo = articles.join(failed, F.col("id") == F.col("_id"), "left_semi").dropDuplicates(["id"])
    _write(todo, f"{results_path}/attempt={attempt}/batch=0", scorer_factory, batch_size)
    return attempt
