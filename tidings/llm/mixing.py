"""Operator 3: mixing sources to target weights.

Words are aggregated per source, weights become target sizes (a source is
repeated ``MAX_REPEATS`` times at most; what it cannot take is shared again by
weight), and each document is emitted floor(rate) times plus one more time with
the probability of the rate's fraction, drawn from a hash of its id and text.
DataFrame functions only.

Edge cases: a null source is a source of its own, last in order; a null or
empty text has size 0 and is emitted like the others of its source; a source
of size 0 has target 0 and rate 0; without documents there is nothing; a row
that is repeated as a whole draws the same number as its copy; rows without
doc_id draw by their text. Columns named as those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import n_words, small, table
from tidings.session import stage

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def source_order(sources: DataFrame) -> DataFrame:
    """``sources`` (rows with a distinct ``_src``) with ``_rank``, the position from 0
    in order of code points, null last: sorted in ranges, and each range numbered
    from the number of rows in those before it."""
    parts = stage(sources.repartitionByRange(F.col("_src").asc_nulls_last())
                  .sortWithinPartitions(F.col("_src").asc_nulls_last())
                  .withColumn("_p", F.spark_partition_id())
                  .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "source-ranges")
    # one row per range: as many as there are shuffle partitions
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("_rank", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From rows (``source``, ``size``) to one row per source: ``_src``,
    ``source_size``, ``target``. All targets add up to all sizes.

    Each round gives every source below its cap its share by weight of what the
    capped ones leave, and caps those whose share is above; no source is ever
    uncapped, and the rounds end when no share is above its cap. Shares are one
    division of whole numbers, so they don't depend on the order of additions.
    """
    sources = source_order(sizes.groupBy(F.col("source").alias("_src")).agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1).cast("long")
    sources = stage(sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * max_repeats), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level: tuple[int, int] | None = None  # target of weight 1, as a fraction
    while True:
        capped = F.lit(False) if level is None else F.col("_cap").cast("decimal(38,0)") * level[1] <= F.col("_w") * F.lit(level[0]).cast("decimal(30,0)")
        left, weights_left = sources.agg(
            F.sum(F.when(capped, F.col("_cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("_w")))).first()
        if not weights_left:
            level = level or (0, 1)
            break
        again = (total - left, weights_left)
        if level is not None and again[0] * level[1] == level[0] * again[1]:
            break
        level = again
    share = (F.col("_w") * level[0]).cast("double") / F.lit(float(level[1]))
    return sources.select("_src", "source_size", F.least(F.col("_cap").cast("double"), share).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of the seed, the id and the text's md5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
             weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """Every input row with ``size``, ``source_size``, ``target`` and ``copies``
    (times to emit it). Sources are joined by broadcast if they are few, else by
    shuffle, where AQE splits a hot source."""
    out = docs.withColumns({"size": n_words(F.col(text)), "_draw": draw(F.col(doc_id), F.col(text), seed)})
    if not keep_text:
        out = stage(out.drop(text), "mix-sizes")
    targets = stage(source_targets(out.select(F.col(source).alias("source"), "size"), weights, max_repeats), "targets")
    out = out.drop("source_size", "target", "copies").join(small(targets), F.col(source).eqNullSafe(F.col("_src")), "left").drop("_src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("_draw") < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("_draw")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every input row as often as :func:`plan_mix` says, with
    the input's columns."""
    planned = plan_mix(docs, **options)
    again = planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = plan_mix(docs, keep_text=False)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank % 3) + 1]::BIGINT AS w, source_size * {MAX_REPEATS} AS cap FROM s),
-- sources in the order in which a rising level caps them; the level is right where the next one isn't capped
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS capped, sum(w) OVER rest AS wleft, sum(source_size) OVER () AS total
      FROM w WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    rest AS (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min(total - capped, cap / w) AS a, arg_min(wleft, cap / w) AS b FROM o WHERE (total - capped) * w < cap * wleft),
t AS (SELECT source, source_size, least(cap::DOUBLE, (w * l.a)::DOUBLE / l.b::DOUBLE) AS target FROM w, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
