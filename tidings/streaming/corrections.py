"""T2 with corrections: daily sentiment that follows labels as they are replaced.

A label may arrive again for an article that has one already (a second run, a
better model). The stream keeps the latest label of every article as state
(``transformWithState``, a map from articles to labels in hash buckets, in the RocksDB store, so that it
may outgrow the executors' memory; a label reads and writes its own article's entry). When a label replaces another, it
emits a retraction of the old one and an addition of the new one; a label that is older than
the known one, or the same, emits nothing. The changes of a micro-batch are
summed by (day, label) and written to ``<store>/changes/batch=<id>``, which a
repeated batch replaces as a whole: a crash or a lost executor never counts twice.

The store is a :mod:`tidings.operators.rollup` one: its days can be read at any time
and compacted between runs.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidings.functions import dates
from tidings.operators import rollup

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: What arrives: one label of an article; the highest version is the latest.
ARRIVING = T.StructType([T.StructField("article_id", T.StringType()), T.StructField("label", T.DoubleType()), T.StructField("version", T.LongType())])
CHANGE = "day int, label double, n long"
#: Groups that Python is called for; the articles of a bucket are looked up one by one, so it may
#: grow. Fixed for the life of a checkpoint.
BUCKETS = 2048


class LatestLabels(StatefulProcessor):
    """Per bucket of articles a map from the article to its latest (version, label, day);
    output: the changes by (day, label) that its rows make."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "article_id string", "version long, label double, day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # a part may hold an article several times: only its latest label asks the store
            part = part.sort_values(["version", "label", "day"]).drop_duplicates("article_id", keep="last")
            change: Counter = Counter()
            for article, version, label, day in zip(part["article_id"], part["version"].tolist(), part["label"].tolist(), part["day"].tolist(), strict=True):
                known = self.latest.getValue((article,))
                if known is None or (version, label) > tuple(known)[:2]:
                    self.latest.updateValue((article,), (version, label, day))
                    change[day, label] += 1
                    if known is not None:
                        change[known[2], known[1]] -= 1
            if change:
                yield pd.DataFrame([(d, x, n) for (d, x), n in change.items()], columns=["day", "label", "n"])

    def close(self) -> None:
        pass


def label_changes(labels: DataFrame, lenient: bool = False) -> DataFrame:
    """Streaming (article_id, label, version) -> changes (day, label, n); labels
    without a day, a label or a version count nowhere (F5)."""
    cloudpickle.register_pickle_by_value(sys.modules["tidings"])  # executors need no install
    day = F.unix_date(dates.article_date("article_id", lenient))
    rows = labels.select("article_id", F.col("label").cast("double").alias("label"), F.col("version").cast("long").alias("version"), day.alias("day"))
    rows = rows.where("day IS NOT NULL AND label IS NOT NULL AND version IS NOT NULL")
    bucket = F.pmod(F.xxhash64("article_id"), F.lit(BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(LatestLabels(), CHANGE, "Append", "None")


def run_correcting_stream(spark: SparkSession, source_path: str, store: str, checkpoint_path: str, lenient: bool = False,
                          schema: T.StructType = ARRIVING, max_files_per_trigger: int | None = None) -> None:
    """Follow everything available in ``source_path`` (``availableNow``) into the
    rollup at ``store``. Restartable from its checkpoint."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def keep(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(F.date_from_unix_date("day").alias("date"), "label", "n")
        rollup.write_changes(changed, store, batch_id)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (label_changes(reader.parquet(source_path), lenient).writeStream.outputMode("append").foreachBatch(keep)
             .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
