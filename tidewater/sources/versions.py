"""Catalog tables whose rewrites are committed as a whole.

A commit writes a fresh folder and then points the catalog's table to it: one change of the catalog, and the only one that readers see.
A commit that fails, or whose driver is killed, leaves the table as it was; what it had written is a folder that no table points to, which
vacuum() deletes. Older versions stay until then, so plans that read them go on, and back_to() returns to one. Tables may be bucketed:
groups and windows on the bucket columns, and joins of tables bucketed alike, then read them without a shuffle. A join on the bucket
columns and others besides needs a session that allows it, see colocating().

Commits to one table come from one writer at a time: of two that read the same version, the later one to commit wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Buckets:
    """n files by hash of the columns by, each in order of the columns sort."""

    n: int
    by: tuple[str, ...]
    sort: tuple[str, ...] = ()


def _quoted(name: str) -> str:
    parts = name.split(".")
    if not all(p.isidentifier() for p in parts):
        raise ValueError(f"{name!r} is no name of a table")
    return ".".join(f"`{p}`" for p in parts)


def colocating(spark: SparkSession) -> SparkSession:
    """A session on the same catalog with the settings of spark, in which tables bucketed by some of a join's keys are joined as they lie.

    Spark shuffles them otherwise, in fear of few distinct bucket keys; spark's own settings stay as they are.
    """
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return other


def table(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is now. spark.table() alone may give the version that this session has read before, where another session has committed since."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def location(spark: SparkSession, name: str) -> str | None:
    """The folder of the table's current version; None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").where("col_name = 'Location'").collect()
    return rows[0].data_type


def _point(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"ALTER TABLE {_quoted(name)} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)


def commit(df: DataFrame, name: str, root: str, buckets: Buckets | None = None) -> DataFrame:
    """Make df the content of the table (database.table), in a fresh folder under root, and return the table as it is now.

    df may read the table itself. Columns that the table lacks are added to it; a column that df lacks, or has in another type, or another bucketing
    raises ValueError before anything is written.
    """
    spark, _ = df.sparkSession, _quoted(name)
    old = table(spark, name).schema if spark.catalog.tableExists(name) else None
    if old is not None:
        _check(spark, name, df, buckets)
        df = df.select(*old.names, *(c for c in df.columns if c not in old.names))
    path = f"{root.rstrip('/')}/{name}/v-{uuid.uuid4().hex}"
    staged = f"{name}__{uuid.uuid4().hex}"
    try:
        _written(df, staged, path, buckets)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(staged)}")
        _delete(spark, path)
        raise
    if old is None:
        spark.sql(f"ALTER TABLE {_quoted(staged)} RENAME TO {_quoted(name)}")
    else:
        new = [c for c in df.schema if c.name not in old.names]
        if new:
            spark.sql(f"ALTER TABLE {_quoted(name)} ADD COLUMNS ({', '.join(f'`{c.name}` {c.dataType.simpleString()}' for c in new)})")
        _point(spark, name, path)
        spark.sql(f"DROP TABLE {_quoted(staged)}")  # external: its files are the table's now
    return table(spark, name)


def _written(df: DataFrame, name: str, path: str, buckets: Buckets | None) -> None:
    if buckets is None:
        df.write.option("path", path).format("parquet").saveAsTable(name)
        return
    out = df.repartition(buckets.n, *buckets.by).write.bucketBy(buckets.n, *buckets.by)  # as buckets are dealt: a file each
    out = out.sortBy(*buckets.sort) if buckets.sort else out
    out.option("path", path).format("parquet").saveAsTable(name)


def _check(spark: SparkSession, name: str, df: DataFrame, buckets: Buckets | None) -> None:
    old = {f.name: f.dataType for f in spark.table(name).schema}
    new = {f.name: f.dataType for f in df.schema}
    if wrong := sorted(c for c in old if new.get(c) != old[c]):
        raise ValueError(f"{name} has columns that don't come, or come in another type: {wrong}")
    said = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").collect()}
    had = (int(said["Num Buckets"]), said["Bucket Columns"].replace("`", "").strip("[]").split(", ")) if "Num Buckets" in said else None
    if had != ((buckets.n, list(buckets.by)) if buckets else None):
        raise ValueError(f"{name} is bucketed as {had}")


def versions(spark: SparkSession, name: str, root: str) -> list[str]:
    """The folders of the table's versions, oldest first. Those of commits that failed half way are among them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [(f.getModificationTime(), f.getPath().toString()) for f in fs.listStatus(at)]
    return [p for _, p in sorted(found)]


def back_to(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Make an older version current again."""
    _point(spark, name, path)
    return table(spark, name)


def vacuum(spark: SparkSession, name: str, root: str, keep: int = 2) -> list[str]:
    """Delete all versions but the current one and the keep last ones, and return their folders. No commit may run meanwhile."""
    now, found = location(spark, name), versions(spark, name, root)
    last = lambda p: p.rsplit("/", 1)[-1]
    gone = [p for p in found[: max(0, len(found) - keep)] if now is None or last(p) != last(now)]
    for p in gone:
        _delete(spark, p)
    return gone


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
