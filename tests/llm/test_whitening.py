import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import whitening as W

SF = "/root/testdata/sf0.01"


def brute(rows):
    """n, S, V and each row's deviation and x of the contract, in Python integers."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    n, dims = len(x), len(next(iter(x.values())))
    s = [sum(v[d] for v in x.values()) for d in range(dims)]
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    z = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x.values()])
    return n, s, dev, z, z.T @ z / n


def matrix(spark, out):
    got = out.orderBy("vec_id", "component").toPandas()
    k = got.component.max()
    return got, got.whitened.to_numpy().reshape(-1, k)


def test_query_against_brute_force(spark):
    out = W.op13_whitening(spark, SF)
    got, w = matrix(spark, out)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, _, dev, z, v = brute(rows)
    e, base = np.linalg.eigh(v)
    e, base = e[::-1], base[:, ::-1]
    assert len(got) == n * 32 and (got.n == n).all() and got.groupby("vec_id").deviation.first().to_dict() == dev
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] <= 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() <= 1e-9
    want = z @ base[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs((want * w).sum(axis=0)) / n - 1).max() < 1e-8  # equal but for each component's sign
    assert np.allclose(got.explained.to_numpy().reshape(-1, 32)[0], e[:32] / np.trace(v), rtol=1e-9)


def test_odd_rows(spark):
    """Nulls, values that aren't finite, huge ones, repeats, a null id, empty and differing lengths, clashing names."""
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1e300, 0.0, 0.0]), (105, [])]
    other = [(200 + i, [float(i), 0.5 * i]) for i in range(5)] + [(300, [7.0])]
    rows = [*good, good[0], (None, [0.1, 0.2, 0.3]), *bad, *other]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, n int, component string, whitened double").repartition(5)
    out = W.whitened(docs)
    got = out.toPandas()
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    three = got[got.n == 42]
    assert len(three) == 42 * 3 and three.vec_id.isna().sum() == 3 and set(three.vec_id.dropna()) == set(range(40))
    keyed = [(k, v) for k, v in enumerate([v for _, v in good] + [good[0][1], [0.1, 0.2, 0.3]])]
    n, _, dev, z, v = brute(keyed)
    assert three[three.vec_id.notna()].groupby("vec_id").deviation.first().to_dict() == {i: dev[i] for i in range(40)}
    assert three.identity_error.iloc[0] < 1e-12 and not three.whitened.isna().any()
    two = got[got.n == 5]  # all on one line, but for rounding down: still of full rank or not, as its integers say
    assert len(two) == 10 and two.identity_error.iloc[0] < 1e-9
    one = got[got.vec_id == 300]
    assert len(one) == 1 and one.n.iloc[0] == 1 and one.deviation.iloc[0] == 0 and one[["whitened", "explained", "identity_error"]].isna().all(axis=None)
    assert set(got.vec_id.dropna()) & set(range(100, 200)) == set()
    assert W.whitened(docs.where(F.lit(False))).count() == 0 and W.whitened(docs.where("vec_id = 100")).count() == 0


def test_constant_dimension_is_no_component(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), 5.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(30, 2)))]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert got[got.component == 3].whitened.isna().all() and not got[got.component < 3].whitened.isna().any()
    assert got.identity_error.iloc[0] < 1e-12 and abs(got[got.vec_id == 0].explained.sum() - 1) < 1e-12
    assert (W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2).agg(F.max("component")).first()[0]) == 2


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12])
def test_sums_and_deviation_are_exact(size):
    """Beyond 2^53 and 2^63 too; what is no long is null."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(300, 4)) * 64 * size).astype(np.int64)
    total = [sum(col) for col in x.T.tolist()]
    m = W.Model(300, total, np.eye(4), np.ones(4), np.ones(4))
    want = [sum((300 * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    assert m.deviation(x).to_pylist() == [v if v <= W.LONG else None for v in want]
    z = m.centred(x)
    assert np.allclose(z, [[(300 * v - s) / 300 for v, s in zip(row, total)] for row in x.tolist()], rtol=1e-15)


def test_parts_merge_to_the_whole():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(500, 5)) + 1e6
    parts = [W.Moments.of(z[i:j]) for i, j in ((0, 1), (1, 100), (100, 500))]
    m = parts[2].merged(parts[0]).merged(parts[1])
    assert m.n == 500 and np.allclose(m.outer / 500, np.cov(z.T, bias=True), rtol=1e-9, atol=1e-9)
    big = W.Sums(3, [1 << 62, -5]).merged(W.Sums(4, [1 << 62, 6]))
    assert big == W.Sums(7, [1 << 63, 1])
