"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors makes a graph of nearest neighbours; the graph is cut into balanced partitions with few edges
between them; a small network learns from a vector where its neighbours lie. The network then puts every row of the table
into its most probable partition and routes each query to its most probable ones, as many as it takes to gather a given share
of the probability; that share is calibrated on rows of the sample which the graph leaves out. What is routed is ranked by
its exact cosine in double precision.

Only the index is learned from the sample (about SAMPLE rows, by a hash of vec_id); all rows are indexed.
Partitions are worked off in tiles of at most about BLOCK_ROWS rows and QUERY_ROWS queries; a tile returns the k best for each of its queries.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take
no part; vectors of different length aren't compared. A query's own vec_id is no candidate, also where rows repeat it; a vec_id
that repeats counts once, with its nearest vector. Ties go to the smaller vec_id. No usable rows or queries: no rows. Other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import table, written
from tidewater.llm.embedding_dedup import _blobs, _matrix, cosines, unit_rows
from tidewater.llm.embedding_dedup import units as normed

K = 5
SAMPLE, HELD_OUT = 8192, 512
GRAPH_NEIGHBOURS = 10
HIDDEN = 64
#: Of the neighbours of held-out sample rows, the share that the calibrated routing finds.
CALIBRATED_RECALL = 0.97
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """The network of one vector length, and the share of probability that a query's partitions gather."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def routed(self, x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, partition) of every partition that each row goes to, the most probable first until they gather mass and least rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        held = sizes[order]
        rows, ranks = np.nonzero((np.cumsum(ranked, axis=1) - ranked < self.mass) | (np.cumsum(held, axis=1) - held < least))
        return rows, order[rows, ranks]


def balanced_partition(neighbours: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12) -> np.ndarray:
    """Cut the graph (row i's neighbours are neighbours[i]) into parts of nearly equal size with few edges between them."""
    n, k = neighbours.shape
    edges = np.zeros((n, parts), np.float64)
    room = -(-n // parts) + max(1, n // (20 * parts))
    part, order = np.full(n, -1), rng.permutation(n)
    both = np.unique(np.r_[np.c_[np.repeat(np.arange(n), k), neighbours.ravel()], np.c_[neighbours.ravel(), np.repeat(np.arange(n), k)]], axis=0)
    at = np.searchsorted(both[:, 0], np.arange(n + 1))
    start = 0
    for p in range(parts):  # grow each part breadth first from a row that has none yet
        todo = []
        size = 0
        while size < n // parts:
            if not todo:
                while start < n and part[order[start]] >= 0:
                    start += 1
                if start == n:
                    break
                todo = [order[start]]
            x = todo.pop(0)
            if part[x] < 0:
                part[x] = p
                size += 1
                near = both[at[x] : at[x + 1], 1]
                todo.extend(near[part[near] < 0])
    part[part < 0] = rng.integers(parts, size=(part < 0).sum())
    for _ in range(sweeps):  # move rows to where most of their edges lead, best gains first, while there is room
        edges[:] = 0
        np.add.at(edges, (np.repeat(np.arange(n), k), part[neighbours].ravel()), 1)
        np.add.at(edges, (neighbours.ravel(), np.repeat(part, k)), 1)
        best = edges.argmax(axis=1)
        gain = edges[np.arange(n), best] - edges[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for x in np.argsort(-gain, kind="stable"):
            if gain[x] <= 0:
                break
            if size[best[x]] < room:
                size[part[x]] -= 1
                part[x] = best[x]
                size[part[x]] += 1
                moved += 1
        if not moved:
            break
    return part


def _nearest(x: np.ndarray, among: np.ndarray, k: int, own: bool) -> np.ndarray:
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ among.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def learned_router(sample: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Partition the sample's graph and train the network on it: full-batch Adam on the cross entropy with its neighbours' partitions."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    held = sample[: min(HELD_OUT, len(sample) // 8)]
    x = sample[len(held) :]
    k = min(GRAPH_NEIGHBOURS, len(x) - 1)
    parts = max(1, min(parts, len(x) // 16))
    net = Router(rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim) * 4, np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts))
    if parts == 1 or k < 1:
        return net
    neighbours = _nearest(x, x, k, True)
    part = balanced_partition(neighbours, parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), part[neighbours].ravel()), 1 / (2 * k))
    goal[np.arange(len(x)), part] += 0.5
    weights = [net.w1, net.b1, net.w2, net.b2]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, 301):
        at = rng.integers(len(x), size=min(len(x), 1024))
        hidden = np.maximum(x[at] @ net.w1 + net.b1, 0)
        d = (net.probabilities(x[at]) - goal[at]) / len(at)
        back = (d @ net.w2.T) * (hidden > 0)
        for i, g in enumerate([x[at].T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            weights[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    if len(held):  # the share of probability before a true neighbour's partition comes up, over all of them
        home = net.probabilities(x).argmax(axis=1)
        p = net.probabilities(held)
        true = home[_nearest(held, x, min(K, len(x)), False)]
        ahead = np.array([[(row[row > row[c]]).sum() for c in near] for row, near in zip(p, true)]).ravel()
        net.mass = float(np.quantile(ahead, CALIBRATED_RECALL)) + 1e-9
    return net


def _partitions(n: int) -> int:
    return int(max(8, np.sqrt(n) / 16))


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors that is_query (a condition on vec_id) picks."""
    spark = vectors.sparkSession

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in unit_rows(b.column("vec_id"), b.column("embedding")):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), _blobs(x)], ["vec_id", "dim", "unit"])

    rows, _ = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(units, "vec_id long, dim int, unit binary"), "units")
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    routers = {}
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(max(sum(counts.values()), SAMPLE))) < SAMPLE
    for dim, part in rows.where(drawn).limit(2 * SAMPLE).select("dim", "unit").toPandas().groupby("dim"):
        x = _matrix(part.unit, np.float64)
        x = x[np.lexsort(x.T)][np.random.default_rng(1).permutation(len(x))]  # the same sample whatever the partitions
        routers[int(dim)] = learned_router(normed(x), _partitions(counts[dim]))
    for dim in set(counts) - set(routers):  # a rare length that the sample lacks: one partition
        routers[dim] = learned_router(np.zeros((0, dim)), 1)

    sizes: dict[int, np.ndarray] = {}

    def placed(queries: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for dim in f.dim.unique():
                    g = f[f.dim == dim]
                    x = _matrix(g.unit, np.float64)
                    at, part = routers[dim].routed(normed(x), sizes[dim], k + 1) if queries else (np.arange(len(x)), routers[dim].probabilities(normed(x)).argmax(axis=1))
                    yield g.iloc[at].assign(part=part.astype(np.int32))

        return run

    schema = "vec_id long, dim int, unit binary, part int"
    data, _ = written(rows.mapInPandas(placed(False), schema), "indexed")
    for dim, router in routers.items():
        sizes[dim] = np.zeros(len(router.b2), np.int64)
    for r in data.groupBy("dim", "part").agg(F.count_distinct("vec_id").alias("ids")).collect():  # a row a partition
        sizes[r.dim][r.part] = r.ids
    asked, _ = written(rows.where(is_query).mapInPandas(placed(True), schema), "routed")
    key = ["dim", "part"]
    dealt = data.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")).join(asked.groupBy(key).agg(F.ceil(F.count("*") / QUERY_ROWS).alias("chunks")), key)
    dealt = F.broadcast(dealt)  # a row a partition: about a sixteenth of the root of the rows
    block, chunk = F.expr("pmod(xxhash64(vec_id, unit), blocks)"), F.expr("pmod(xxhash64(vec_id, unit), chunks)")
    sides = data.join(dealt, key).select(*key, block.alias("block"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "vec_id", "unit", F.lit(False).alias("asks"))
    sides = sides.union(asked.join(dealt, key).select(*key, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), chunk.alias("chunk"), "vec_id", "unit", F.lit(True).alias("asks")))

    def best(f: pd.DataFrame) -> pd.DataFrame:
        asks = f.asks.to_numpy()
        ids, queries = f.vec_id.to_numpy()[~asks], f.vec_id.to_numpy()[asks]
        if not len(ids) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, y = _matrix(f.unit[~asks], np.float64), _matrix(f.unit[asks], np.float64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        unit = normed(x)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = []
        for i in range(0, len(queries), 256):
            s = normed(y[i : i + 256]) @ unit.T
            s[queries[i : i + 256, None] == ids] = -2
            each = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
            at = len(first) - min(k, len(first))
            r, c = np.nonzero((s >= np.partition(each, at, axis=1)[:, at, None] - 1e-9) & (s > -1.5))
            exact = np.concatenate([np.empty(0)] + [cosines(y[i + r[j : j + 16_384]], x[c[j : j + 16_384]]) for j in range(0, len(r), 16_384)])
            order = np.lexsort((-exact, ids[c], r))  # of rows that repeat an id the nearest
            order = order[np.r_[True, (r[order][1:] != r[order][:-1]) | (ids[c[order]][1:] != ids[c[order]][:-1])]] if len(r) else order
            order = order[np.lexsort((ids[c[order]], -exact[order], r[order]))]
            r, c, exact = r[order], c[order], exact[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            out.append(pd.DataFrame({"query_id": queries[i + r[keep]], "vec_id": ids[c[keep]], "score": exact[keep]}))
        return pd.concat(out)

    found = sides.groupBy("dim", "part", "block", "chunk").applyInPandas(best, FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
