"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One ASCII white space: what separates words in the contracts of ops 1-3.
BLANK = r"[\x20\x09-\x0D]"
#: Rows up to which a table of known, small row width is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often (or inside
    whatever lambda) the body uses it; the optimizer cannot inline it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def n_words(text: Column) -> Column:
    """Number of such runs, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged or cheap to count) marked for broadcast if it has at most
    ``rows`` rows, else as it is, so that Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
