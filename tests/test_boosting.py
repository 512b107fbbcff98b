import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater import queries_scoring as Q
from tidewater.plans import boosting as B
from tidewater.plans import models as M
from tidewater.plans import decisions as D
from tidewater.plans.boosting import BoostParams
from tidewater.sources.shared import written


def reference_tree(bins, g, h, params):
    """Best leaf first, over all rows in memory: {leaf's set of rows: value}."""
    def split(rows):
        s = np.zeros((bins.shape[1], params.bins, 3))
        for f in range(bins.shape[1]):
            for i, v in enumerate((g, h, np.ones(len(g)))):
                s[f, :, i] = np.bincount(bins[rows, f], v[rows], minlength=params.bins)
        return B._best_split(s, params)

    leaves = [(np.arange(len(g)), split(np.arange(len(g))))]
    while len(leaves) < params.leaves and any(s for _, s in leaves):
        k = max((k for k in range(len(leaves)) if leaves[k][1]), key=lambda k: leaves[k][1][0])
        rows, (_, f, b) = leaves.pop(k)
        for part in (rows[bins[rows, f] <= b], rows[bins[rows, f] > b]):
            leaves.append((part, split(part)))
    return {tuple(r): -params.rate * g[r].sum() / (h[r].sum() + params.l2) for r, _ in leaves}


def test_trees_are_best_leaf_first(spark):
    """The first trees of both kinds against the same growth in memory, row by row; nulls, a category and weights included."""
    rng = np.random.default_rng(1)
    n = 900
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.choice(["x", "y", "z"], n)
    y = 3 * (a > 0.3) * (b > 1) + np.sin(3 * a) + (c == "y") + 0.1 * rng.normal(size=n)
    rows = [(i, None if i % 17 == 0 else float(a[i]), float(b[i]), str(c[i]), float(y[i]), bool(y[i] > 1.2), float(1 + i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c string, y double, p boolean, w double").repartition(5)
    for label, binary in (("y", False), ("p", True)):
        params = BoostParams(trees=2, rate=0.3, leaves=9, min_child=12, bins=32)
        m = B.fit(df, ["a", "b", "c"], label, binary, params, weight="w")
        t = df.orderBy("i").toArrow()
        bins = m.binned({k: t[k].combine_chunks() for k in "abc"})
        yy, w = np.array(t[label].to_pylist(), float), t["w"].to_numpy()
        score = np.full(n, m.first)
        for tree in m.trees:
            p = B._chance(score) if binary else score
            want = reference_tree(bins, w * (p - yy), w * (p * (1 - p) if binary else 1), params)
            assert len(want) == 9 == len(set(tree.leaves(bins)))
            value = np.zeros(n)
            for r, v in want.items():
                value[list(r)] = v
            assert np.allclose(tree.values(bins), value, atol=1e-9)
            score += value
        got = B.predicted(m, df, "out").orderBy("i").toArrow()["out"].to_numpy()
        assert np.allclose(got, B._chance(score) if binary else score, atol=1e-9)


def test_scores_written_between_stages_change_nothing(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.sin(F.col("id") % 20).alias("y"))
    params = BoostParams(trees=6, min_child=5, leaves=4)
    one = B.fit(df, ["a", "b"], "y", False, params)
    monkeypatch.setattr(B, "STAGE", 2)
    two = B.fit(df, ["a", "b"], "y", False, params)
    assert [(t.feature, t.bin) for t in one.trees] == [(t.feature, t.bin) for t in two.trees] and np.allclose([t.value[-1] for t in one.trees], [t.value[-1] for t in two.trees])


def test_odd_labels_and_columns(spark):
    df = spark.createDataFrame([(1.0, "k", None, 2), (None, None, 3.0, 4), (float("nan"), "k", 3.0, 5)], "a double, s string, y double, _f0 int")
    m = B.fit(df, ["a", "s"], "y", False, BoostParams(trees=3))
    assert m.trees == [] and m.first == 3.0  # nothing to split
    out = B.predicted(m, df, "y2").collect()
    assert [r.y2 for r in out] == [3.0] * 3 and out[0]._f0 == 2
    with pytest.raises(ValueError):
        B.fit(df.where("y is null"), ["a"], "y", False)
    unseen = m.binned({"a": pa.array([1.0]), "s": pa.array(["new"])})
    assert unseen.tolist()[0][1] == 0


def _stand_in(train, test, features, label):
    """Depth-wise trees of Spark's own, as many, with the same rate and weights."""
    n = train.agg(F.count("*").alias("n"), F.count_if(label).alias("p")).first()
    ready = lambda d: d.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"f_{c}") for c in features))
    weight = F.when(F.col(label), n.n / (2 * n.p)).otherwise(n.n / (2 * (n.n - n.p)))
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=4, maxDepth=5, stepSize=0.05, seed=42)
    stages = [StringIndexer(inputCol="fuel_type", outputCol="f_fuel", handleInvalid="keep"), VectorAssembler(inputCols=[*(f"f_{c}" for c in features), "f_fuel"], outputCol="_x"), gbt]
    fitted = Pipeline(stages=stages).fit(ready(train).withColumns({"_y": F.col(label).cast("double"), "_w": weight}))
    return fitted.transform(ready(test)).select(F.col(label).alias("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def _precision(scored):
    """Average precision: what matters is the order, as the stand-in takes its first tree whole and ours a twentieth of each."""
    rows = scored.select(F.lit("all").alias("fuel_type"), F.col("y").alias("actual"), F.col("p").alias("probability"))
    return D.average_precision(rows).first().average_precision


def test_beats_the_depth_wise_stand_in_on_held_out_rows(spark):
    """Four trees of each on a rule of a few features that is deep on one side, learned from two thirds of the rows."""
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=(n, 6))
    rule = (x[:, 0] > 0) & ((np.floor(4 * x[:, 1]) % 2 == 0) ^ (x[:, 2] > 0.4)) | (x[:, 3] + x[:, 4] > 2)
    y = rule ^ (rng.random(n) < 0.05)
    df = spark.createDataFrame([(*map(float, r), "U91" if i % 2 else "DL", bool(v), i % 3 == 0) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, d double, e double, f double, fuel_type string, y boolean, held boolean").repartition(4)
    train, test, features = df.where("not held"), df.where("held"), list("abcdef")
    ours = M.jump_probabilities(M.jump_classifier(train, "y", features, trees=4), test).select("y", F.col("jump_probability").alias("p"))
    a, b = _precision(ours), _precision(_stand_in(train, test, features, "y"))
    print("average precision", a, b)
    assert a > b


def test_beats_it_on_the_markets_held_out_days(spark):
    sf = "/root/testdata/sf0.01"
    t = written(Q.D.training_set(Q.inputs(spark, sf), Q.eligible(spark, sf), Q.labels(spark, sf)), "t")
    train, test = t.where(F.col("market_date") <= F.lit(Q.TRAIN_END)), t.where(F.col("market_date") > F.lit(Q.TRAIN_END))
    ours = M.jump_probabilities(M.jump_classifier(train, trees=4), test).select(F.col("jump_within_48h").alias("y"), F.col("jump_probability").alias("p"))
    a, b = _precision(ours), _precision(_stand_in(train, test, M.FEATURES, "jump_within_48h"))
    print("average precision", a, b)
    assert a > b
