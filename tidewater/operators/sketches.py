"""Quantiles from mergeable sketches (KLL): one is stored for each group and day, and any span of days is answered from those, without the rows.

A sketch of size k answers a rank within about 2.296 / k**0.9021 of the rows (at 99 % confidence, for one quantile; 1.33 % at k = 200), and exactly while it has
no more values than k. Merging keeps that bound. Nulls and nan don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400


def rank_error(k: int = K) -> float:
    """The normalised rank error of one quantile that a sketch of size k keeps with 99 % confidence."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """by, n, sketch: what to store of each group, such as a fuel and day."""
    x = F.when(~F.isnan(value), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged(stored: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """by, n, sketch: of coarser groups, from stored sketches."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def trailing(stored: DataFrame, by: list[str], day: str, days: int, k: int = K) -> DataFrame:
    """by, day, n, sketch: for every stored day of a group the sketch of the last so many days, itself included. Each stored sketch goes to the days that it counts in: an equi-join's work, no window over rows."""
    spread = stored.withColumn(day, F.explode(F.sequence(F.col(day), F.date_add(day, days - 1), F.expr("interval 1 day"))))
    return merged(spread.join(stored.select(*by, day), [*by, day], "left_semi"), [*by, day], k)


def quantile(sketch: str, q: float) -> Column:
    """The value of that rank; null where nothing was counted."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q)))


def rank(sketch: str, value: Column) -> Column:
    """The share of values not above the given one."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_rank_double(F.col(sketch), value))
