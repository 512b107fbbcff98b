"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, where it runs on this machine alone and names no folder.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own if all runs on this machine, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidewater-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends, if the session still lives then."""

    def end() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return

    atexit.register(end)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: plans that read it several times compute it once, and nothing stays in executors' storage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_database(spark: SparkSession) -> str:
    """The name of a fresh database, dropped with its tables when the driver ends."""
    name = f"tidewater_{uuid.uuid4().hex}"

    def end() -> None:
        try:
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
        except Exception:  # the session has ended, and with it a catalog in memory
            return

    atexit.register(end)
    return name
