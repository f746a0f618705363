"""A current table kept up to date by snapshots (S2, U4), touching only what changes.

The table holds the latest row of every key, in hash buckets of the key. Merging a
snapshot reads only the buckets that the snapshot has keys of and writes only these, as
the next generation: ``<store>/gen=<number>/bucket=<k>``. Nothing is written over:
the current state of a bucket is its newest complete generation. A merge with the
same number replaces its own generation and reads only older ones, so it can be repeated
after a crash, with the same result.

Which row is the latest is decided by ``order`` columns (numbers, dates or strings,
compared in turn), the merged snapshot winning where they are equal. Winners are
picked on keys and order columns; wide columns are neither sorted nor aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.operators.learn import id_hash
from tidings.operators.rollup import complete_folders
from tidings.session import stage

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return (id_hash(key) % buckets).cast("int")


def _generations(spark: SparkSession, store: str, before: int | None) -> dict[int, int]:
    """The newest complete generation of every bucket, from the list of folders."""
    newest: dict[int, int] = {}
    for gen in complete_folders(spark, store, "gen"):
        if before is None or gen < before:
            newest.update(dict.fromkeys(complete_folders(spark, f"{store}/gen={gen}", "bucket", marker=False), gen))
    return newest


def read_current(spark: SparkSession, store: str, schema: T.StructType, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The current rows with their ``gen`` and ``bucket``; of some buckets only, or as they were before a generation."""
    found = _generations(spark, store, before)
    paths = [f"{store}/gen={g}/bucket={b}" for b, g in sorted(found.items()) if buckets is None or b in set(buckets)]
    whole = T.StructType([*schema.fields, T.StructField("gen", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    if not paths:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", store).parquet(*paths)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the largest by the order columns, of equal ones the one met first.

    The rows are staged with their place; keys, order columns and place alone are
    ranked, in windows that hold the rows of one key (a limit of one row passes through the
    shuffle for each key and task), and the rows come from a semi join on the place."""
    placed = stage(rows.where(F.col(key).isNotNull()).withColumn("_place", F.monotonically_increasing_id()), "snapshot")
    first = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order], "_place")
    kept = placed.select(key, *order, "_place").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("_place")
    return placed.join(kept, "_place", "left_semi").drop("_place")


def _not_older(order: list[str]) -> Column:
    """Whether the snapshot's row (``_new_``) is at least as late as the current one (``_old_``); nulls are oldest."""
    later, equal = F.lit(False), F.lit(True)
    for c in order:
        a, b = F.col(f"_new_{c}"), F.col(f"_old_{c}")
        later = later | (equal & a.isNotNull() & (b.isNull() | (a > b)))
        equal = equal & a.eqNullSafe(b)
    return F.coalesce(later | equal, F.lit(False))


def merge(snapshot: DataFrame, store: str, number: int, key: str = "id", order: list[str] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merge a snapshot into the table as generation ``number``; the buckets it touched.

    The snapshot's winners are staged. Only narrow columns (key and order) of the
    touched buckets meet those of the snapshot; both sides' rows then pass a
    semi join with the keys that they win. A bucket all of whose rows stay as they are is not written."""
    spark, order = snapshot.sparkSession, list(order or [])
    new = latest(snapshot, key, order) if order else latest(snapshot.withColumn("_none", F.lit(0)), key, ["_none"]).drop("_none")
    new = stage(new.withColumn("bucket", bucket_of(key, buckets)), "snapshot-winners")
    met = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = read_current(spark, store, snapshot.schema, met, before=number).drop("gen")
    a = new.select(F.col(key).alias("_key"), "bucket", *[F.col(c).alias(f"_new_{c}") for c in order])
    b = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in order], F.lit(True).alias("_known"))
    both = a.join(b, "_key", "left").withColumn("_wins", F.col("_known").isNull() | _not_older(order))
    wins = stage(both.where("_wins").select("_key", "bucket"), "winning-keys")
    touched = sorted(r[0] for r in wins.select("bucket").distinct().collect())
    if not touched:
        return []
    inside = F.col("bucket").isin(touched)
    won = wins.select("_key")
    rows = new.join(won, F.col(key) == F.col("_key"), "left_semi").unionByName(
        old.where(inside).join(won, F.col(key) == F.col("_key"), "left_anti").select(*new.columns))
    # one task a bucket and about as many rows each, since buckets are hashes of the key
    rows.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/gen={number}")
    return touched
