"""Label merging, consensus and rater agreement.

Labels travel in a long table ``(article_id, rater, label[, src_file, pos])``.
Everything here is one or two hash aggregations keyed by ``article_id`` (with
map-side partial aggregation), never a window over raw rows: a hot id or a
dominant class cannot pile up in one task beyond what its partial aggregates
hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions.parse import LABEL_NAMES


def merge_label_files(batches: DataFrame, id_col: str = "article_id", label_col: str = "label",
                      file_col: str = "src_file", pos_col: str = "pos") -> DataFrame:
    """U4: union of label batches; per id the label of the last file in name
    order wins (then the last position inside that file). One sort-based
    aggregation, since its key holds the file's name; what is sorted is id,
    label, file and position, never a text."""
    return batches.groupBy(id_col).agg(
        F.max_by(F.col(label_col), F.struct(F.col(file_col), F.col(pos_col))).alias(label_col))


def merge_file_stats(batches: DataFrame, id_col: str = "article_id", file_col: str = "src_file") -> DataFrame:
    """Per file, labels in it, ids new at that file (first file in name
    order that has the id) and duplicates. Aggregates only (no window)."""
    per_id_file = batches.groupBy(file_col, id_col).agg(F.lit(1).alias("_one"))
    first_seen = per_id_file.groupBy(id_col).agg(F.min(file_col).alias(file_col))
    new = first_seen.groupBy(file_col).agg(F.count(F.lit(1)).alias("new_labels"))
    total = per_id_file.groupBy(file_col).agg(F.count(F.lit(1)).alias("labels_in_file"))
    return (total.join(new, file_col, "left")
            .select(F.col(file_col).alias("file"), "labels_in_file",
                    F.coalesce("new_labels", F.lit(0)).cast("long").alias("new_labels"))
            .withColumn("duplicates", F.col("labels_in_file") - F.col("new_labels")))


def dedupe_label_map(rows: DataFrame, id_col: str = "article_id", pos_col: str = "pos",
                     label_col: str = "label", keys: tuple = ("src_file", "rater")) -> DataFrame:
    """Q18: a JSON object with a repeated key keeps the last occurrence."""
    group = [k for k in keys if k in rows.columns] + [id_col]
    return rows.groupBy(*group).agg(F.max_by(F.col(label_col), F.col(pos_col)).alias(label_col))


def consensus(labels: DataFrame, id_col: str = "article_id", label_col: str = "label",
              rounded: bool = True) -> DataFrame:
    """Average of all raters per id.

    ``rounded=True`` (A7): with two or more raters the mean is rounded half to
    even (Python ``round``); a single rater's label is kept as is.
    ``rounded=False`` (A8): plain mean. Output ``(article_id, label, n_raters)``.
    """
    g = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(
        F.avg(label_col).alias("_mean"), F.count(label_col).alias("n_raters"))
    lab = F.when(F.col("n_raters") > 1, F.bround("_mean", 0)).otherwise(F.col("_mean")) if rounded \
        else F.col("_mean")
    return g.select(id_col, lab.cast("double").alias(label_col), F.col("n_raters").cast("long"))


def pair_wide(labels: DataFrame, rater_a: str, rater_b: str, id_col: str = "article_id",
              rater_col: str = "rater", label_col: str = "label") -> DataFrame:
    """J2 for two raters: ``(article_id, label_a, label_b)``, a full outer
    merge expressed as one conditional aggregation (one shuffle)."""
    r = F.col(rater_col)
    return labels.where(r.isin(rater_a, rater_b)).groupBy(id_col).agg(
        F.max(F.when(r == rater_a, F.col(label_col))).alias("label_a"),
        F.max(F.when(r == rater_b, F.col(label_col))).alias("label_b"))


def rater_agreement(wide: DataFrame) -> DataFrame:
    """A5 + A6 + J7 in one pass over the wide pair: overlap counts and, on ids
    both raters labelled, mean / max absolute difference and differing rows."""
    a, b = F.col("label_a"), F.col("label_b")
    both = a.isNotNull() & b.isNotNull()
    diff = F.when(both, F.abs(a - b))
    return wide.agg(
        F.count_if(both).alias("both"),
        F.count_if(a.isNotNull() & b.isNull()).alias("only_a"),
        F.count_if(a.isNull() & b.isNotNull()).alias("only_b"),
        F.count(F.lit(1)).alias("total"),
        F.avg(diff).alias("mean_abs_diff"),
        F.max(diff).alias("max_abs_diff"),
        F.count_if(both & (a != b)).alias("n_differ"))


def label_distribution(labels: DataFrame, label_col: str = "label", group_cols: list[str] | None = None) -> DataFrame:
    """A4: counts of the five classes with zero fill and percent of all rows.

    A class counts rows whose label equals it exactly (a .5 label is in the
    denominator but in no class, like the reference). Empty input -> 0 %.
    One aggregate counts all rows and the five classes; its row per group is
    then unfolded into a row per class.
    """
    group_cols = group_cols or []
    lab = F.col(label_col)
    counts = labels.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(lab == i).alias(f"n{i}") for i in range(len(LABEL_NAMES))])
    rows = [F.struct(F.lit(i).alias("label"), F.lit(name).alias("name"), F.col(f"n{i}").alias("count"),
                     F.coalesce(F.try_divide(F.col(f"n{i}") * 100.0, F.col("total")), F.lit(0.0)).alias("pct"))
            for i, name in enumerate(LABEL_NAMES)]
    return counts.select(*group_cols, F.inline(F.array(*rows)))


def overlap_sets(left: DataFrame, right: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Intersection and both differences of two id sets, as counts."""
    l_ids = left.select(id_col).distinct().withColumn("_l", F.lit(True))
    r_ids = right.select(id_col).distinct().withColumn("_r", F.lit(True))
    j = l_ids.join(r_ids, id_col, "full")
    return j.agg(F.count_if(F.col("_l") & F.col("_r")).alias("both"),
                 F.count_if(F.col("_l") & F.col("_r").isNull()).alias("only_left"),
                 F.count_if(F.col("_l").isNull() & F.col("_r")).alias("only_right"))
