"""Evaluation metrics over long prediction tables (A9-A16, A25, safe correlation).

A prediction table is long: ``(model, article_id, y_true, y_pred)``. Every
metric is an aggregate grouped by model (or by ``(model, y_true, y_pred)``
for the confusion-matrix family), so millions of predictions collapse into at
most 25 cells per model after one partially-aggregated shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = [0, 1, 2, 3, 4]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(x, y) -> Column:
    """Pearson correlation that is NULL (not an error) for constant, one-row
    or empty input. Pairs with a missing side are dropped first, as pandas
    ``Series.corr`` does. ``corr`` itself raises DIVIDE_BY_ZERO under ANSI."""
    x, y = _col(x), _col(y)
    ok = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(ok, x), F.when(ok, y)
    den = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(F.covar_pop(xs, ys), F.when(den > 0, den))


def mae(y_true="y_true", y_pred="y_pred") -> Column:
    """Mean absolute error."""
    return F.avg(F.abs(_col(y_true) - _col(y_pred)))


def accuracy(y_true="y_true", y_pred="y_pred") -> Column:
    """A10: share of exact matches (an unparseable -1 counts as wrong)."""
    return F.avg((_col(y_true) == _col(y_pred)).cast("double"))


def evaluation_summary(preds: DataFrame, group_cols=("model",), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """A13 (+A25): per model n, accuracy, MAE and unparseable count."""
    return preds.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        accuracy(y_true, y_pred).alias("accuracy"),
        mae(y_true, y_pred).alias("mae"),
        F.count_if(_col(y_pred) == -1).alias("unparseable"))


def confusion_counts(preds: DataFrame, group_cols=("model",), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Raw ``(group..., y_true, y_pred, n)`` counts - the one shuffle every
    classification metric below is derived from."""
    return preds.groupBy(*group_cols, _col(y_true).alias("y_true"), _col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, group_cols=("model",), classes=CLASSES,
                     y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Full ``len(classes)``^2 grid per group with zero fill; pairs with a
    value outside ``classes`` are left out. The groups come from the same count
    table as the cells: the predictions are read once."""
    group_cols = list(group_cols)
    cells = [(t, p) for t in classes for p in classes]
    n = confusion_counts(preds, group_cols, y_true, y_pred)
    # a few counts a group, as a map by the place of the cell in the grid
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true").cast("int")) * len(classes) \
        + F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_pred").cast("int")) - len(classes) - 1
    listed = F.col("y_true").isin(list(classes)) & F.col("y_pred").isin(list(classes))
    held = n.groupBy(*group_cols).agg(F.map_from_entries(F.collect_list(F.when(listed, F.struct(place.alias("k"), F.col("n").alias("v"))))).alias("_counts"))
    grid = F.array(*[F.struct(F.lit(k).cast("long").alias("_k"), F.lit(t).alias("y_true"), F.lit(p).alias("y_pred")) for k, (t, p) in enumerate(cells)])
    rows = held.select(*group_cols, "_counts", F.inline(grid))
    return rows.select(*group_cols, "y_true", "y_pred", F.coalesce(F.try_element_at("_counts", "_k"), F.lit(0)).cast("long").alias("n"))


def classification_report(preds: DataFrame, group_cols=("model",), classes=None,
                          y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Per class precision / recall / F1 / support, plus ``accuracy``,
    ``micro avg``, ``macro avg`` and ``weighted avg`` rows; division by zero -> 0.

    ``classes=None``: classes are the values seen in truth or prediction per
    group (scikit-learn default); a list fixes them (``labels=`` argument).
    Output ``(group..., row, precision, recall, f1, support)`` with ``row`` the
    class as text or the summary name.

    Plan: the ``(y_true, y_pred)`` count table (one shuffle of the
    predictions), each count cell exploded into its truth-side and
    prediction-side contribution (plus zero rows for fixed classes) and summed
    per class (one shuffle of <= 25 cells per group), then one aggregate per
    group for the summary rows.
    """
    group_cols = list(group_cols)
    cc = confusion_counts(preds, group_cols, y_true, y_pred)
    eq = F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("long")

    def part(cls, sup, tp, pred, all_n, ok_n):
        return F.struct(cls.cast("long").alias("cls"), sup.alias("sup"), tp.alias("tp"), pred.alias("pred"),
                        all_n.alias("all_n"), ok_n.alias("ok_n"))

    parts = [part(F.col("y_true"), F.col("n"), F.when(eq, F.col("n")).otherwise(zero), zero,
                  F.col("n"), F.when(eq, F.col("n")).otherwise(zero)),
             part(F.col("y_pred"), zero, zero, F.col("n"), zero, zero)]
    if classes is not None:
        parts += [part(F.lit(c), zero, zero, zero, zero, zero) for c in classes]
    per = (cc.select(*group_cols, F.inline(F.array(*parts)))
             .groupBy(*group_cols, "cls")
             .agg(F.sum("sup").alias("support"), F.sum("tp").alias("tp"), F.sum("pred").alias("predicted"),
                  F.sum("all_n").alias("all_n"), F.sum("ok_n").alias("ok_n")))
    listed = F.col("cls").isin(list(classes)) if classes is not None else F.lit(True)
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), z)
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), z)
    per = per.withColumn("listed", listed).withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), z))

    def on_listed(c):
        return F.when(F.col("listed"), c)

    summ = per.groupBy(*group_cols).agg(
        F.sum(on_listed(F.col("tp"))).alias("tp_all"), F.sum(on_listed(F.col("predicted"))).alias("pred_all"),
        F.sum(on_listed(F.col("support"))).alias("sup_all"),
        F.avg(on_listed(F.col("precision"))).alias("macro_p"), F.avg(on_listed(F.col("recall"))).alias("macro_r"),
        F.avg(on_listed(F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum(on_listed(F.col("precision") * F.col("support"))),
                     F.sum(on_listed(F.col("support")))).alias("w_p"),
        F.try_divide(F.sum(on_listed(F.col("recall") * F.col("support"))),
                     F.sum(on_listed(F.col("support")))).alias("w_r"),
        F.try_divide(F.sum(on_listed(F.col("f1") * F.col("support"))),
                     F.sum(on_listed(F.col("support")))).alias("w_f1"),
        F.sum("all_n").alias("n_all"), F.sum("ok_n").alias("n_ok"))
    micro_p = F.coalesce(F.try_divide(F.col("tp_all").cast("double"), F.col("pred_all")), z)
    micro_r = F.coalesce(F.try_divide(F.col("tp_all").cast("double"), F.col("sup_all")), z)
    micro_f1 = F.coalesce(F.try_divide(2 * micro_p * micro_r, micro_p + micro_r), z)
    acc = F.coalesce(F.try_divide(F.col("n_ok").cast("double"), F.col("n_all")), z)
    sup_all = F.coalesce(F.col("sup_all"), F.lit(0)).cast("long")

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.alias("support"))

    rows = F.array(
        row("accuracy", acc, acc, acc, F.col("n_all").cast("long")),
        row("micro avg", micro_p, micro_r, micro_f1, sup_all),
        row("macro avg", F.coalesce("macro_p", z), F.coalesce("macro_r", z), F.coalesce("macro_f1", z), sup_all),
        row("weighted avg", F.coalesce("w_p", z), F.coalesce("w_r", z), F.coalesce("w_f1", z), sup_all))
    summary_rows = summ.select(*group_cols, F.inline(rows))
    class_rows = per.where(F.col("listed")).select(*group_cols, F.col("cls").cast("string").alias("row"),
                                                   "precision", "recall", "f1",
                                                   F.col("support").cast("long").alias("support"))
    return class_rows.unionByName(summary_rows)


def agreement(wide: DataFrame, a="pred_a", b="pred_b") -> DataFrame:
    """A14 + A15: share of equal predictions and their Pearson correlation."""
    return wide.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((_col(a) == _col(b)).cast("double")).alias("agreement"),
                    safe_corr(a, b).alias("correlation"))


def prediction_histogram(preds: DataFrame, models: list[str], model_col="model", score_col="y_pred") -> DataFrame:
    """A16 + U2: counts per score for each model over the union of scores,
    zero-filled; one row per score, one column per model."""
    return (preds.where(F.col(model_col).isin(models))
            .groupBy(F.col(score_col).alias("score")).pivot(model_col, models)
            .agg(F.count(F.lit(1))).na.fill(0, models)
            .orderBy("score"))  # O2: a handful of score rows
