"""W1-W3 on series too long for one task (ticks, minutes): windows over slices.

The windows of :mod:`tidings.operators.series` hold a series' rows in one task, which is
right for days. Here a series is cut into slices of ``slice_rows`` consecutive rows,
wherever its days or hours lie, by the rows' positions (W6: ranges, no global
window). A row's return, rolling mean and leads need at most ``halo`` rows on
either side, so every slice gets copies of the ``halo`` rows around it. Forward filling may reach
back any distance: what it needs is one number, the last known close before
the slice's first copy, which is carried over from the slices before, a row a
slice. The result equals the windows over whole series, and no task holds more than a slice and its halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.operators.profile import with_row_index
from tidings.operators.series import LAGS, ROLLING, rolling_mean

SLICE_ROWS = 1_000_000


def sliced_features(ticks: DataFrame, order_cols: list[str], close_col: str = "close", symbol_col: str = "symbol",
                    smooth: tuple = (), rolling: int = ROLLING, lags=LAGS, fill_gaps: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``ticks`` with ``return`` (W1, gaps filled), ``return_smoothed`` and
    ``<col>_smoothed`` of the columns of ``smooth`` (W2), and ``return_lead<k>`` (W3), in the
    order of ``order_cols`` within each symbol (rows equal in all of them may swap places)."""
    halo = max(rolling, *lags, 1)
    if slice_rows < halo:
        raise ValueError(f"a slice must have at least {halo} rows")
    rows = with_row_index(ticks, order_cols, "_i", group_cols=[symbol_col])
    own = F.floor(F.col("_i") / slice_rows)
    rows = rows.withColumns({"_own": own, "_offset": F.col("_i") % slice_rows})
    # the slice itself, the one before (as rows that follow it) and the one after (as rows before it)
    slices = F.filter(F.array(F.col("_own"), F.when((F.col("_offset") < halo) & (F.col("_own") > 0), F.col("_own") - 1),
                              F.when(F.col("_offset") >= slice_rows - halo, F.col("_own") + 1)), lambda s: s.isNotNull())
    copies = rows.withColumn("_slice", F.explode(slices))
    if fill_gaps:
        # what is known before the first copy of slice s: the rows whose (position + halo) is in a slice before s
        held = rows.where(F.col(close_col).isNotNull()).groupBy(symbol_col, F.floor((F.col("_i") + halo) / slice_rows).alias("_slice")).agg(
            F.max_by(close_col, "_i").alias("_last"))
        every = rows.groupBy(symbol_col, F.floor((F.col("_i") + halo) / slice_rows).alias("_slice")).agg(F.count("*").alias("_rows"))
        before = Window.partitionBy("_symbol").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(held, [symbol_col, "_slice"], "left").withColumnRenamed(symbol_col, "_symbol")
        carried = carried.select("_symbol", F.col("_slice").alias("_at"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        copies = copies.join(carried, F.col(symbol_col).eqNullSafe(F.col("_symbol")) & (F.col("_slice") == F.col("_at")), "left")
    w = Window.partitionBy(symbol_col, "_slice").orderBy("_i")
    known = F.coalesce(F.last(close_col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried")) if fill_gaps else F.col(close_col)
    out = copies.withColumn("_filled", known)
    out = out.withColumn("return", F.try_divide(F.col("_filled"), F.lag("_filled", 1).over(w)) - F.lit(1.0))
    made = {"return_smoothed": rolling_mean("return", w, rolling)} | {f"{c}_smoothed": rolling_mean(c, w, rolling) for c in smooth}
    made |= {f"return_lead{k}": F.lead("return", k).over(w) for k in lags}
    out = out.withColumns(made).where(F.col("_slice") == F.col("_own"))
    return out.select(*[c for c in ticks.columns if c not in made and c != "return"], "return", *made)
