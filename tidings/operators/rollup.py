"""A stored daily rollup of labels.

A day's state is the number of articles by label: rows (series..., date,
label, n). Such states add up, and a negative ``n`` takes a label back, so
that the mean, count, smallest and largest label of a day are exact after any
sequence of additions and corrections; they never need the labels again. There are at most as many
rows in a day as label values (nine with steps of a half).

On disk a rollup is a folder with ``base/upto=<k>``, all changes up to number k
summed, and ``changes/batch=<k>``, what each later write changed. Writing a
number again replaces it. :func:`compact` writes the next base beside the
old one; a reader takes the newest base that is complete and the changes after
it, so a crash at any point loses and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField("date", T.DateType()), T.StructField("label", T.DoubleType()), T.StructField("n", T.LongType())])


def day_states(labels: DataFrame, date_col: str = "date", label_col: str = "label", series_cols=()) -> DataFrame:
    """The states of dated labels: one aggregate, combined by tasks before the
    shuffle. Rows without a date (F5) or a label are left out."""
    rows = labels.where(F.col(date_col).isNotNull() & F.col(label_col).isNotNull())
    return rows.groupBy(*series_cols, F.col(date_col).alias("date"), F.col(label_col).cast("double").alias("label")).agg(F.count("*").alias("n"))


def add_states(states: DataFrame, series_cols=()) -> DataFrame:
    """States summed; what has been taken back completely is gone."""
    return states.groupBy(*series_cols, "date", "label").agg(F.sum("n").alias("n")).where("n <> 0")


def daily(states: DataFrame, series_cols=()) -> DataFrame:
    """A3 from states: (series..., date, sentiment, n_articles, min_label, max_label)."""
    held = add_states(states, series_cols)
    days = held.groupBy(*series_cols, "date").agg(
        F.sum(F.col("label") * F.col("n")).alias("_sum"), F.sum("n").alias("n_articles"), F.min("label").alias("min_label"), F.max("label").alias("max_label"))
    return days.select(*series_cols, "date", (F.col("_sum") / F.col("n_articles")).alias("sentiment"), "n_articles", "min_label", "max_label")


def complete_folders(spark: SparkSession, path: str, name: str, marker: bool = True) -> list[int]:
    """Numbers of the sub-folders ``<name>=<number>`` of ``path`` (with ``marker``: that were written to the end)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    found = [n for n in names if n.startswith(f"{name}=")]
    done = [n for n in found if not marker or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def write_changes(changes: DataFrame, store: str, number: int, series_cols=()) -> None:
    """Write what change ``number`` adds and takes back (rows (series..., date, label, n))."""
    add_states(changes, series_cols).write.mode("overwrite").parquet(f"{store}/changes/batch={number}")


def read_states(spark: SparkSession, store: str, schema: T.StructType = STATE) -> DataFrame:
    """The rows of the newest base and of all changes after it; :func:`daily` sums them."""
    bases = complete_folders(spark, f"{store}/base", "upto")
    upto = bases[-1] if bases else -1
    paths = [f"{store}/base/upto={upto}"] if bases else []
    paths += [f"{store}/changes/batch={k}" for k in complete_folders(spark, f"{store}/changes", "batch") if k > upto]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, store: str, schema: T.StructType = STATE) -> int:
    """Sum the newest base and the changes after it into a new base; its number (-1: nothing to do).
    Older folders are left for the caller to remove when no reader uses them."""
    bases, changes = complete_folders(spark, f"{store}/base", "upto"), complete_folders(spark, f"{store}/changes", "batch")
    last = changes[-1] if changes else -1
    if last <= (bases[-1] if bases else -1):
        return bases[-1] if bases else -1
    series = [f for f in schema.fieldNames() if f not in ("date", "label", "n")]
    add_states(read_states(spark, store, schema), series).write.mode("overwrite").parquet(f"{store}/base/upto={last}")
    return last
