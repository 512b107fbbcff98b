"""Inserts, updates and rewrites of Parquet tables, as plans: what the new state of a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, source: DataFrame, key: list[str], latest: str | None = None) -> DataFrame:
    """target and the rows of source whose key it lacks. With latest, one row of source a key counts, that of the highest value."""
    source = latest_row(source, key, latest) if latest else source
    return target.unionByName(source.join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """source's rows in place of those with their key, all others as they are."""
    return target.join(source.select(*key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def update_columns(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Existing rows take the given columns from source and keep the rest; new rows come whole."""
    s = source.select(*key, *(F.col(c).alias(f"_new_{c}") for c in target.columns if c not in key), F.lit(True).alias("_there"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(s, key, "full_outer")
    kept = lambda c: F.when(F.col("_old").isNull() | (F.col("_there") if c in columns else F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c))
    return both.select(*(F.col(c) if c in key else kept(c).alias(c) for c in target.columns))


def replace_where(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """source in place of all rows that share its values of columns: delete, then insert."""
    return target.join(source.select(*columns).distinct(), columns, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def latest_row(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row a key, that of the highest by; ties go to the row whose columns compare highest."""
    rest = [c for c in rows.columns if c not in (*key, by)]
    best = rows.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("_best"))
    return best.select(*key, "_best.*").select(*rows.columns)


def first_rows(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def replace_all(target: DataFrame, source: DataFrame) -> DataFrame:
    """source in target's columns: delete everything, then insert."""
    return source.select(*target.columns)
