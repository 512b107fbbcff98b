"""Gradient boosting of leaf-wise trees on histograms, fitted by Spark jobs.

Features become bin numbers once (quantiles of all rows), in a table of the shared folder. A tree grows by its best leaf: of all leaves the one
whose best split gains most is split next, until there are enough leaves or no split gains anything. What a split gains follows from sums
of gradients and hessians by node, feature and bin: tasks sum up their rows in numpy, an aggregate adds the tasks, and the driver sees nodes x
features x bins sums, whatever the number of rows. A pass sums up the children of all nodes that may be split soon, so a tree takes about as
many passes as it is deep; of two siblings only the left one is summed up, the other is what remains of their parent. Scores are written to
the table every STAGE trees; in between, tasks add the trees since then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.shared import new_path, remove

#: Trees after which scores are written.
STAGE = 10


@dataclass(frozen=True)
class BoostParams:
    trees: int = 200
    rate: float = 0.05
    leaves: int = 31
    min_child: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    #: Bins of a feature, the lowest of which holds nulls.
    bins: int = 64


@dataclass
class Tree:
    """Node k sends bins of its feature up to bin to left, others to right; -1 where it is a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows x features)."""
        at, feature, cut, left, right = np.zeros(len(bins), np.int32), *(np.array(x, np.int32) for x in (self.feature, self.bin, self.left, self.right))
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            k = at[rows]
            at[rows] = np.where(bins[rows, feature[k]] <= cut[k], left[k], right[k])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    categories: dict[str, list[str]]
    binary: bool
    first: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: dict[str, pa.Array]) -> np.ndarray:
        """Bin numbers, rows x features: 0 for null (and categories never seen), else 1 and more."""
        out = []
        for name, edges in zip(self.features, self.edges):
            if name in self.categories:
                known = {v: float(i) for i, v in enumerate(self.categories[name])}
                x = np.array([known.get(v, np.nan) for v in columns[name].to_pylist()])
            else:
                x = columns[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            out.append(np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x)).astype(np.uint8))
        return np.ascontiguousarray(np.array(out).T)

    def scores(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        return sum((t.values(bins) for t in (self.trees if trees is None else trees)), np.zeros(len(bins)))


def _chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def fit(rows: DataFrame, features: list[str], label: str, binary: bool, params: BoostParams = BoostParams(), weight: str | None = None) -> Boosted:
    """A model of label (boolean or number; rows where it is null don't count). Strings among the features are categories, in order of their names.

    weight: a column of weights; none: 1, and for a binary label each class weighs half of the rows.
    """
    if not 2 <= params.bins <= 255:
        raise ValueError("2 to 255 bins")
    rows = rows.where(F.col(label).isNotNull())
    kinds = dict(rows.dtypes)
    texts = [f for f in features if kinds[f] == "string"]
    numbers = [f for f in features if f not in texts]
    x = {f: F.col(f).cast("double") for f in numbers}
    y = F.col(label).cast("double")
    cuts = [i / (params.bins - 1) for i in range(1, params.bins - 1)]
    stats = rows.agg(F.count("*").alias("_n"), F.sum(y).alias("_sum"), *(F.percentile_approx(F.when(~F.isnan(c), c), cuts, 10_000).alias(f"q{i}") for i, c in enumerate(x.values())), *(F.sort_array(F.collect_set(f)).alias(f"c{i}") for i, f in enumerate(texts))).first()
    if not stats._n:
        raise ValueError("no rows to learn from")
    categories = {f: list(stats[f"c{i}"]) for i, f in enumerate(texts)}
    if wide := [f for f, c in categories.items() if len(c) > params.bins - 1]:
        raise ValueError(f"more categories than bins: {wide}")
    edges = [np.arange(max(len(categories[f]) - 1, 0)) + 0.0 if f in categories else np.unique(np.array(stats[f"q{numbers.index(f)}"] or [], float)) for f in features]
    share = stats._sum / stats._n
    balanced = F.when(F.col(label).cast("boolean"), stats._n / (2 * max(stats._sum, 1))).otherwise(stats._n / (2 * max(stats._n - stats._sum, 1))) if binary else F.lit(1.0)
    w = F.col(weight).cast("double") if weight else balanced
    if binary:
        total = rows.agg(F.sum(w * y).alias("p"), F.sum(w).alias("w")).first()
        share = min(max(total.p / total.w, 1e-15), 1 - 1e-15)
    model = Boosted(features, edges, categories, binary, float(np.log(share / (1 - share))) if binary else float(share))
    _grow(rows.select(y.alias("_y"), w.alias("_w"), *(x.get(f, F.col(f)).alias(f"_f{i}") for i, f in enumerate(features))), model, params)
    return model


def _grow(rows: DataFrame, model: Boosted, params: BoostParams) -> None:
    spark = rows.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = model.binned({f: b.column(f"_f{i}") for i, f in enumerate(model.features)})
            yield pa.RecordBatch.from_arrays([b.column("_y"), b.column("_w"), pa.array(np.full(len(bins), model.first)), pa.array([r.tobytes() for r in bins], pa.binary())], ["y", "w", "score", "bins"])

    kind = "y double, w double, score double, bins binary"
    path = new_path(spark, "boosting")
    rows.mapInArrow(first, kind).write.parquet(path)
    since: list[Tree] = []
    for k in range(params.trees):
        table = spark.read.schema(kind).parquet(path)
        tree = _tree(table, model, since, params)
        if tree.feature[0] < 0:
            break  # nothing gains any more
        model.trees.append(tree)
        since.append(tree)
        if len(since) == STAGE and k + 1 < params.trees:
            held = list(since)

            def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    bins = _matrix(b.column("bins"), len(model.features))
                    yield pa.RecordBatch.from_arrays([b.column("y"), b.column("w"), pa.array(b.column("score").to_numpy() + model.scores(bins, held)), b.column("bins")], ["y", "w", "score", "bins"])

            new = new_path(spark, "boosting")
            table.mapInArrow(scored, kind).write.parquet(new)
            remove(spark, path)
            path, since = new, []
    remove(spark, path)


def _matrix(blobs: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(blobs), width)


def _tree(table: DataFrame, model: Boosted, since: list[Tree], params: BoostParams) -> Tree:
    """The next tree. Nodes below its leaves are there on trial: their sums are known, or asked for next."""
    tree, sums, splits, count = Tree(), {}, {}, params.leaves
    tree.add()
    parent, active, inner = {}, [0], set()
    while True:
        # On trial: the children of the leaves, and of those nodes on trial below them that gain most, no more than there may be leaves.
        trial = sorted((k for k in splits if splits[k] and k not in inner and k not in active), key=lambda k: -splits[k][0])
        below = [k for k in active if splits.get(k)] + trial[:count]
        for k in below:
            if tree.left[k] < 0:
                tree.feature[k], tree.bin[k] = splits[k][1:]
                tree.left[k], tree.right[k] = tree.add(), tree.add()
                parent[tree.left[k]] = parent[tree.right[k]] = k
        wanted = [0] if 0 not in sums else [tree.left[k] for k in below if tree.left[k] not in sums]
        if wanted:
            found = _sums(table, model, since, tree, wanted, params.bins)
            for k in wanted:
                sums[k] = found[k]
                if k:
                    up = parent[k]
                    sums[tree.right[up]] = sums[up] - found[k]
            for k in list(sums):
                if k not in splits:
                    splits[k] = _best_split(sums[k], params)
        known = True
        while known and len(active) < count:
            open_ = [k for k in active if splits[k]]
            if not open_:
                break
            best = max(open_, key=lambda k: (splits[k][0], -k))
            known = tree.left[best] >= 0 and tree.left[best] in sums
            if known:
                inner.add(best)
                active.remove(best)
                active += [tree.left[best], tree.right[best]]
        if known:
            break
    for k in active:  # what was on trial below the leaves goes
        tree.feature[k] = tree.left[k] = tree.right[k] = -1
        g, h = sums[k][0, :, 0].sum(), sums[k][0, :, 1].sum()
        tree.value[k] = float(-params.rate * g / (h + params.l2)) if h > 0 else 0.0
    return tree


def _sums(table: DataFrame, model: Boosted, since: list[Tree], tree: Tree, wanted: list[int], bins: int) -> dict[int, np.ndarray]:
    """By wanted node: features x bins x (gradients, hessians, rows)."""
    width, slots = len(model.features), {k: i for i, k in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(wanted), width, bins))
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = list(slots.values())
        for b in batches:
            x, y, w = _matrix(b.column("bins"), width), b.column("y").to_numpy(), b.column("w").to_numpy()
            score = b.column("score").to_numpy() + model.scores(x, since)
            p = _chance(score) if model.binary else score
            g, h = w * (p - y), w * (p * (1 - p) if model.binary else 1)
            at = slot[tree.leaves(x)]
            rows = np.flatnonzero(at >= 0)
            for f in range(width):
                key = at[rows] * bins + x[rows, f]
                for i, v in enumerate((g, h, None)):
                    total[i, :, f] += np.bincount(key, None if v is None else v[rows], minlength=len(wanted) * bins).reshape(-1, bins)
        node, f, bin_ = np.nonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (node, f, bin_)] + [pa.array(total[i, node, f, bin_]) for i in range(3)], ["node", "feature", "bin", "g", "h", "n"])

    parts = table.mapInArrow(run, "node int, feature int, bin int, g double, h double, n double")
    found = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(wanted), width, bins, 3))
    at = tuple(found[c].to_numpy() for c in ("node", "feature", "bin"))
    for i, c in enumerate(("g", "h", "n")):
        out[(*at, i)] = found[c].to_numpy()
    return {k: out[i] for k, i in slots.items()}


def _best_split(sums: np.ndarray, params: BoostParams) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split, the first of equals; None if none gains or leaves both sides enough."""
    left = sums.cumsum(axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    good = (left[..., 2] >= params.min_child) & (right[..., 2] >= params.min_child) & (left[..., 1] >= params.min_hessian) & (right[..., 1] >= params.min_hessian)
    if not good.any():
        return None
    of = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + params.l2, 1e-300)
    gain = np.where(good, of(left) + of(right) - of(sums[:1].sum(axis=1)), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-10 else None


def predicted(model: Boosted, rows: DataFrame, name: str) -> DataFrame:
    """rows with name: the probability of a binary label, else the value."""
    names = [f"_c{i}" for i in range(len(rows.columns))]
    numbered = rows.toDF(*names)
    of = dict(zip(rows.columns, names))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            score = m.first + m.scores(m.binned({f: b.column(f"_f{i}") for i, f in enumerate(m.features)}))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(_chance(score) if m.binary else score)], [*names, "_score"])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    x = [(F.col(of[f]) if f in model.categories else F.col(of[f]).cast("double")).alias(f"_f{i}") for i, f in enumerate(model.features)]
    out = numbered.select(*names, *x).mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "_score double"]))
    return out.select(*(F.col(n).alias(c) for c, n in of.items()), F.col("_score").alias(name))
