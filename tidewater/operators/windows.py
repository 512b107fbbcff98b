"""Trailing windows over ordered series. Frames count rows, not days, and never look ahead but in labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def trailing_share(x: Column, w: WindowSpec, n: int) -> Column:
    """Share of the other values of the last n rows that are not above this one; null if it is null or alone."""
    seen = F.collect_list(x).over(last_rows(w, n))
    return F.try_divide(F.size(F.filter(seen, lambda v: v <= x)) - F.lit(1.0), F.when(x.isNotNull(), F.size(seen) - F.lit(1.0)))


def with_rows_since(df: DataFrame, flag: Column, w: WindowSpec, name: str) -> DataFrame:
    """Rows since flag was last true (0 where it is), null before."""
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_at", F.when(flag, F.col("_n")))
    return rows.withColumn(name, F.col("_n") - F.max("_at").over(so_far(w))).drop("_n", "_at")


def days_since(marked: Column, day: Column, w: WindowSpec) -> Column:
    """Days since the last day that is marked (a date where it is, else null)."""
    return F.datediff(day, F.max(marked).over(so_far(w)))


def with_rows_unchanged(df: DataFrame, x: str, w: WindowSpec, name: str) -> DataFrame:
    """Rows since x last changed; 0 on the first row and at each change."""
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_same", F.col(x).eqNullSafe(F.lag(x).over(w)) & (F.col("_n") > 1))
    return rows.withColumn("_at", F.when(~F.col("_same"), F.col("_n"))).withColumn(name, F.col("_n") - F.max("_at").over(so_far(w))).drop("_n", "_same", "_at")


def trend(x: Column, n: Column, w: WindowSpec, rows: int, ahead: int) -> Column:
    """The least-squares line through the last rows, ahead rows on, n numbering the rows; null with less than two."""
    frame = last_rows(w, rows)
    return F.when(F.count(x).over(frame) >= 2, F.regr_intercept(x, n).over(frame) + F.regr_slope(x, n).over(frame) * (n + ahead))
