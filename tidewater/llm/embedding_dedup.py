"""Embedding near-duplicates by int8 tile products with error bounds.

Every vector is scaled to length 1 and quantised to int8 with a scale of its own; the length of what quantisation left out is
its error bound e. Then |x.y - q(x).q(y)| <= e(x) + (1 + e(x)) e(y), so a product of int8 tiles (exact: integers below 2^24 in
float32 matrix products) shows which pairs can't reach the threshold and which surely do. Only those between are computed again in
double precision, from the vectors as given, by one formula.

Rows are dealt into blocks of about BLOCK_ROWS by their nearest pivot (a bounded sample of vectors; it steers the work, not
the result) and a hash. Two cells whose pivots' angle exceeds the sum of their radii by more than the threshold's angle hold
no link, so no tile of theirs is computed. A tile returns a row for each of its linked vectors (number of links, root of the
links' forest within the tile), never its pairs; sums and connected components make the result. Where vectors have no
clusters the pivots exclude nothing and the work is quadratic in the rows: all n^2/2 int8 products.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors
of different length. Rows with a null vec_id come back with no links and no component. Rows that repeat a vec_id do not link
with each other and share links and component. Ties don't arise. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import connected_components, table, written

THRESHOLD = 0.95
BLOCK_ROWS = 8192
TILE_ROWS = 2048
#: Pivots at most, and rows that they are chosen from. Both only steer the work.
PIVOTS, PIVOT_SAMPLE = 1024, 8192
#: Products of this many int8 components sum exactly in float32.
EXACT_DIMS = 1024
QUANTISED = "vec_id long, dim int, q binary, scale double, err double, raw binary"


def unit_rows(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, vectors in double precision, multiplied by powers of two, which changes no digit and keeps squares finite) of the usable rows, one pair for each length that occurs."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    offsets = np.asarray(vectors.offsets, np.int64)
    values = vectors.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null: nan
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(usable, offsets[1:] - offsets[:-1], 0)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        x = values[offsets[rows][:, None] + np.arange(dim)]
        largest = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (largest > 0)
        yield keys[rows[good]], np.ldexp(x[good], -np.frexp(largest[good])[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with the same row of y."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _stored(vectors: DataFrame) -> type:
    """Single-precision vectors are kept as such."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def quantised(vectors: DataFrame) -> DataFrame:
    stored = _stored(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw in unit_rows(b.column("vec_id"), b.column("embedding")):
                x = units(raw)
                scale = np.abs(x).max(axis=1) / 127
                q = np.rint(x / scale[:, None])
                left = x - q * scale[:, None]
                err = np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), x.shape[1], np.int32)), _blobs(q.astype(np.int8)), pa.array(scale), pa.array(err), _blobs(raw.astype(stored))],
                    ["vec_id", "dim", "q", "scale", "err", "raw"],
                )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, QUANTISED)


def _blobs(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(blobs: pd.Series, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1)


def _in_cells(rows: DataFrame, pivots: dict[int, np.ndarray], stored: type) -> DataFrame:
    """rows with cell (nearest pivot of the same length) and angle to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, angle = np.zeros(len(f), np.int32), np.zeros(len(f))
            for dim in f.dim.unique():
                at = np.flatnonzero(f.dim == dim)
                if dim in pivots:
                    near = units(_matrix(f.raw.iloc[at], stored).astype(np.float64)) @ pivots[dim].T
                    cell[at] = near.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                else:
                    angle[at] = np.pi
            yield f.assign(cell=cell, angle=angle)

    return rows.mapInPandas(run, f"{QUANTISED}, cell int, angle double")


def _pivots(rows: DataFrame, n: int, stored: type) -> dict[int, np.ndarray]:
    """About one pivot for each block of rows, by length: vectors far from each other, out of a bounded sample."""
    sample = rows.select("dim", "raw", F.xxhash64("vec_id").alias("h")).orderBy("h", "raw").limit(PIVOT_SAMPLE).toPandas()
    out = {}
    for dim, part in sample.groupby("dim"):
        x = units(_matrix(part.raw, stored).astype(np.float64))
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(PIVOTS, n // BLOCK_ROWS, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[int(dim)] = x[chosen]
    return out


def tile_links(a: dict, b: dict | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile: number of links and root (an index) of each row of a, then of b. b None: a with itself.

    a and b: id, q (float32 with int8 values), scale, err, raw.
    """
    other = a if b is None else b
    first = 0 if b is None else len(a["id"])
    total = first + len(other["id"])
    links, root = np.zeros(total, np.int64), np.arange(total)
    for i in range(0, len(a["id"]), TILE_ROWS):
        x = {k: v[i : i + TILE_ROWS] for k, v in a.items()}
        for j in range(i if b is None else 0, len(other["id"]), TILE_ROWS):
            y = {k: v[j : j + TILE_ROWS] for k, v in other.items()}
            product = sum(x["q"][:, d : d + EXACT_DIMS] @ y["q"][:, d : d + EXACT_DIMS].T for d in range(0, x["q"].shape[1], EXACT_DIMS))
            product *= y["scale"].astype(np.float32)
            bound = x["err"] + (1 + x["err"]) * y["err"].max() + 1e-5
            least, surely = ((threshold + s * bound) / x["scale"] for s in (-1, 1))
            r, c = np.nonzero(product >= least.astype(np.float32)[:, None])
            apart = x["id"][r] != y["id"][c]
            if b is None and i == j:
                apart &= r < c
            r, c = r[apart], c[apart]
            linked = product[r, c] >= surely.astype(np.float32)[r]
            open_ = np.flatnonzero(~linked)
            for k in range(0, len(open_), 16_384):
                at = open_[k : k + 16_384]
                linked[at] = cosines(x["raw"][r[at]], y["raw"][c[at]]) >= threshold
            r, c = r[linked] + i, c[linked] + first + j
            links += np.bincount(r, minlength=total) + np.bincount(c, minlength=total)
            _join(root, r, c)
    return links, root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the trees of each a and b together; every row points at its root before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def links_by_tile(rows: DataFrame, stored: type, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, links, root) of every vector of every tile that has links in it; rows as quantised() makes them."""
    spark = rows.sparkSession
    n = rows.count()
    pivots = _pivots(rows, n, stored)
    celled, _ = written(_in_cells(rows, pivots, stored), "celled")
    cells = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("dim", "cell").collect()  # at most PIVOTS for each length
    first, firsts, blocks = 0, [], []
    for c in cells:
        firsts.append(first)
        blocks.append(-(-c.n // BLOCK_ROWS))
        first += blocks[-1]
    pairs = []
    for i, x in enumerate(cells):
        for j, y in enumerate(cells[i:], i):
            if x.dim == y.dim:
                between = np.arccos(np.clip(pivots[x.dim][x.cell] @ pivots[y.dim][y.cell], -1, 1)) if x.dim in pivots else 0
                if between - x.radius - y.radius <= np.arccos(threshold) + 1e-6:
                    pairs.append((firsts[i], firsts[i] + blocks[i] - 1, firsts[j], firsts[j] + blocks[j] - 1))
    starts = spark.createDataFrame([(c.dim, c.cell, f, b) for c, f, b in zip(cells, firsts, blocks)], "dim int, cell int, first int, blocks int")
    tiles = (
        spark.createDataFrame(pairs, "i0 int, i1 int, j0 int, j1 int")
        .select(F.explode(F.sequence("i0", "i1")).alias("i"), "j0", "j1")
        .select("i", F.explode(F.sequence("j0", "j1")).alias("j"))
        .where("i <= j")
    )
    members = tiles.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = celled.join(F.broadcast(starts), ["dim", "cell"]).withColumn("block", F.expr("first + cast(pmod(xxhash64(vec_id, q), blocks) as int)"))

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(f.i.iloc[0]), int(f.j.iloc[0])
        sides = []
        for block in (i, j) if i < j else (i,):
            part = f[f.block == block]
            if len(part):
                sides.append({"id": part.vec_id.to_numpy(), "q": _matrix(part.q, np.int8).astype(np.float32), "scale": part.scale.to_numpy(), "err": part.err.to_numpy(), "raw": _matrix(part.raw, stored).astype(np.float64)})
        if len(sides) < 1 + (i < j):
            return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
        links, root = tile_links(sides[0], sides[1] if i < j else None, threshold)
        ids, at = np.concatenate([s["id"] for s in sides]), np.flatnonzero(links)
        return pd.DataFrame({"vec_id": ids[at], "links": links[at], "root": ids[root[at]]})

    columns = ["vec_id", "block", "q", "scale", "err", "raw"]
    return dealt.select(columns).join(members, "block").groupBy("i", "j").applyInPandas(tile, "vec_id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    rows, _ = written(quantised(vectors), "quantised")
    found, _ = written(links_by_tile(rows, _stored(vectors), threshold), "links")
    component = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    return (
        vectors.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
