"""What several operators share: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. A fixed value of several query contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of whole texts that Spark hands to Python.
BATCH_BYTES = 2 << 20


def setting_bytes(value: str) -> int:
    """Bytes of a setting such as 64m, 2kb or 1048576."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", value.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def small_batches(spark: SparkSession) -> None:
    """Have the session hand whole texts to Python in batches of at most BATCH_BYTES (or one row), where it allows more.

    Spark reads this setting when a plan runs, so that it can't be put back before. It bounds memory and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < setting_bytes(str(spark.conf.get(key))) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about so many bytes in the text column, or one row: small ones are put together, large ones are cut."""
    held, size = [], 0
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        own, i = int(sizes[-1]) if len(sizes) else 0, 0
        if held and size + own > most:
            yield _together(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
        if own <= most:
            held, size = [*held, b], size + own
            continue
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
            yield b.take(pa.array(np.arange(i, j)))  # copied: some functions go wrong on a slice
            i = j
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], schema=batches[0].schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins, and the end; the UTF-8 bytes of all texts); null: empty. texts may be a slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


class Runs:
    """Ids of stretches of text that are encoded by themselves, each once: a worker keeps the first ones that it meets.

    new(runs) gives an order of the runs, all ids in it, the number of ids of each and flags of each (runs, any number).
    """

    def __init__(self, new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], kept: int, dtype: type, flags: int = 0):
        self.new, self.kept, self.known = new, kept, pa.array([], pa.large_string())
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.flags = np.zeros(0, dtype), np.zeros((0, flags), bool)

    def numbers(self, runs: pa.Array) -> np.ndarray:
        """A number for each of the distinct runs, by which the arrays know it until forget()."""
        numbers = pc.fill_null(pc.index_in(runs, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            order, ids, lengths, flags = self.new(runs.take(pa.array(missing)).to_pylist())
            missing = missing[order]
            numbers[missing] = np.arange(len(self.length), len(self.length) + len(missing))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(lengths) - lengths]
            self.length, self.flat, self.flags = np.r_[self.length, lengths], np.r_[self.flat, ids], np.r_[self.flags, flags]
            kept = missing[: max(0, self.kept - len(self.known))]
            if len(kept):
                self.known = pa.concat_arrays([self.known, runs.take(pa.array(kept))])
        return numbers

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, one behind the other; where each begins, and the end)."""
        n = self.length[numbers]
        upto = np.r_[0, np.cumsum(n)]
        wide = np.int64 if max(upto[-1], len(self.flat)) > 1 << 30 else np.int32
        at = np.repeat((self.start[numbers] - upto[:-1]).astype(wide), n)
        at += np.arange(upto[-1], dtype=wide)
        return self.flat[at], upto

    def forget(self) -> None:
        """What isn't kept goes."""
        kept = len(self.known)
        if len(self.length) > kept:
            self.start, self.length, self.flags = self.start[:kept], self.length[:kept], self.flags[:kept]
            self.flat = self.flat[: int(self.start[-1] + self.length[-1]) if kept else 0]


#: By application, where it runs on this machine alone and names no folder.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, one of our own if all run on this machine, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidewater-")
        _own[spark.sparkContext.applicationId] = given
    return given.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended: the folder's owner cleans up
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: lineage is cut, and a lost executor takes nothing along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that must not be broadcast: it grows with the input, and Spark's guess, by bytes of compressed files, would build it on the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a long, b long): component is the smallest id reachable.

    Alternates large-star and small-star steps (each edge moves to the smallest neighbour of its end), so a chain of n
    ids takes about log n rounds and a group never has more edges than ids. Every round is written to the shared folder;
    nothing but two numbers a round reaches the driver. Nulls and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        new, new_path_ = written(_small_star(_large_star(now)), "edges")
        new_mark = _mark(new)
        remove(spark, path)
        now, path = new, new_path_
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every id hands each larger neighbour the smallest id that it knows, itself included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every id hands itself and its smaller neighbours the smallest of them. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(shuffled(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
