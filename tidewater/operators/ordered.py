"""Running values over keys of any size: rows are dealt to tasks by ranges of key and order, and what a key had before a range is carried in.

A window over a key alone puts all of its rows in one task. Here a key that is longer than a range goes on in the next ranges; a table with a
row for each range (at most) tells each what came before. So the largest task holds a range, whatever the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.shared import written


def in_ranges(rows: DataFrame, by: list[str], order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """rows with _range, written to the shared folder, so that later reads find the same ranges: as many as the session has shuffle partitions, if not said.

    A range's rows stand before the next one's, by key and order; rows equal in both share a range.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def carried(ranged: DataFrame, by: list[str], of_range: dict[str, Column], over: dict[str, tuple[str, str]]) -> DataFrame:
    """(_range, by, names of over) for the keys that go on from an earlier range: one at most in each range, so the table is as small as the number of ranges.

    of_range: aggregates of a key's rows in a range, by name; over: (function, name of an aggregate) that sums up the key's earlier ranges, sum or last.
    """
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.groupBy("_range", *by).agg(*(x.alias(n) for n, x in of_range.items()))
    make = {"sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    rows = rows.withColumn("_earlier", F.count("*").over(before)).withColumns({n: make[f](c) for n, (f, c) in over.items()})
    return rows.where("_earlier > 0").select("_range", *by, *over)


def _with(ranged: DataFrame, by: list[str], earlier: DataFrame) -> DataFrame:
    """ranged beside what was carried in; null keys match null keys."""
    e = earlier.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in earlier.columns if c != "_range" and c not in by))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return ranged.join(F.broadcast(e), same, "left").drop("_r", *(f"_by_{c}" for c in by))


def with_prefix_sums(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """rows with running sums of integers, new name: column, over each key in order up to each row; rows equal in key and order count together in any order."""
    ranged = in_ranges(rows, by, order, ranges)
    earlier = carried(ranged, by, {f"_t_{n}": F.sum(c) for n, c in sums.items()}, {f"_e_{n}": ("sum", f"_t_{n}") for n in sums})
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(ranged, by, earlier).withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) + F.coalesce(f"_e_{n}", F.lit(0)) for n, c in sums.items()})
    return out.select(*rows.columns, *sums)


def with_last_before(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with name, the last value that isn't null up to each row, over each key in order."""
    ranged = in_ranges(rows, by, order, ranges)
    last = F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order)))[value]
    earlier = carried(ranged, by, {"_t": last}, {"_e": ("last", "_t")})
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(ranged, by, earlier).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(here), F.col("_e")))
    return out.select(*rows.columns, name)
