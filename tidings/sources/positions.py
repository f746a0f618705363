"""A position index of a Parquet table (W6, F7): ranges of rows without a sort.

A row's position is the number of rows in the files before its own plus its place
in the file. The files are taken in order of their names, as the reference takes its
article files. The index, one row a file (file, first, n), is built from the
files' own row counts and stored beside the table; Spark knows a row's place in its file
(``_metadata.row_index``). Reading positions ``[start, start + count)`` opens the
files that hold them and no other.

A table written by :func:`tidings.sources.writers.write_in_order` has its rows in
order over the files; any other has them as they were written. The index is of
the files that it was built from: after a change of the table it has to be built again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Count the rows of every file and write (file, first, n). Only the counts
    pass through one window: a row a file, not the table's rows."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.mode("overwrite").parquet(index_path)


def with_position(spark: SparkSession, path: str, index_path: str, index_col: str = "idx") -> DataFrame:
    """Every row of the table with its position: a scan and a join with the index."""
    table = spark.read.parquet(path)
    index = spark.read.parquet(index_path).select(F.col("file").alias("_file"), "first")
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")).join(index, "_file")
    return rows.select(*table.columns, (F.col("first") + F.col("_place")).cast("long").alias(index_col))


def read_positions(spark: SparkSession, path: str, index_path: str, start: int, count: int, index_col: str = "idx") -> DataFrame:
    """the rows at positions ``[start, start + count)``, clipped to the table, with their
    position. Only files that hold some of them are opened; their names, which grow with
    ``count`` and not with the table, come from the index."""
    start, end = max(0, start), max(0, start) + max(0, count)
    held = spark.read.parquet(index_path).where((F.col("first") < end) & (F.col("first") + F.col("n") > start)).collect()
    table = spark.read.parquet(path)
    if not held:
        return table.select("*", F.lit(0).cast("long").alias(index_col)).limit(0)
    some = spark.read.schema(table.schema).parquet(*[f"{path}/{r['file']}" for r in held])
    firsts = F.create_map(*[x for r in held for x in (F.lit(r["file"]), F.lit(r["first"]))])
    rows = some.select("*", (firsts[F.col("_metadata.file_name")] + F.col("_metadata.row_index")).cast("long").alias(index_col))
    return rows.where((F.col(index_col) >= start) & (F.col(index_col) < end))
