"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: str, value: Column, out: str, span: int = 4096, levels: int = 2) -> DataFrame:
    """rows with `out`: the sum of value over the rows before, in the order of a whole-number column, nulls first.

    Rows are summed inside spans of the order column, and the spans' sums in the same way, for so many
    levels. Only the last level's sums, one row for span ** levels numbers, are ordered in one place.
    """
    near, own, inner, base = (f"_{name}{levels}" for name in ("span", "value", "inside", "base"))
    ahead = Window.unboundedPreceding, -1
    before = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(*ahead)), F.lit(0))
    rows = rows.withColumns({near: F.floor(F.col(order) / span).cast("long"), own: value.cast("long")})
    sums = rows.groupBy(near).agg(F.sum(own).alias("_sum"))
    if levels > 1:
        sums = running_total(sums, near, F.col("_sum"), base, span, levels - 1)
    else:
        sums = sums.withColumn(base, before("_sum", Window.orderBy(near)))
    inside = rows.withColumn(inner, before(own, Window.partitionBy(near).orderBy(order)))
    sums = sums.drop("_sum").withColumnRenamed(near, f"{near}_")
    return inside.join(sums, F.col(near).eqNullSafe(F.col(f"{near}_"))).withColumn(out, F.col(base) + F.col(inner)).drop(near, f"{near}_", own, inner, base)
