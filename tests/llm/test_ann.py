import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import ann

SCHEMA = "vec_id long, embedding array<double>, part int, dim string, unit int, rank int"


def brute(rows, queries, k=5):
    good = [(i, np.array(v, np.float64) / max(map(abs, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            best = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -2), x @ y / np.sqrt((x @ x) * (y @ y)))
            out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "d", 2, 3) for i, v in rows], SCHEMA)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    monkeypatch.setattr(ann, "SAMPLE", 512)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.4 * rng.normal(size=24)]) for i in range(1600)]
    df = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0)
    got, want = found(df), brute(rows, set(range(0, 1600, 20)))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_small_tables_are_exact(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (9, v), (3, v), (4, [3.0, 2.0, 1.0]), (50, v), (50, v), (100, [0.0, 0.0, 0.0]), (150, None), (200, [1.0]), (250, [1.0, None, 2.0]), (300, [float("nan"), 1.0, 1.0]), (None, v), (7, [-1.0, -2.0, -3.0]), (8, [2.0**600, 2.0**601, 3 * 2.0**600]), (9, [3.0, 2.0, 1.0]), (350, [])]
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, {0, 50})
    assert [i for _, i in got[0]] == [3, 8, 9, 50, 4]
    assert ann.search(frame(spark, rows).where("vec_id < 0"), F.lit(True)).count() == 0
    assert ann.search(frame(spark, rows), F.lit(False)).count() == 0


def test_partition_is_balanced():
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 50, axis=0) + 0.05 * rng.normal(size=(400, 8))
    neighbours = ann._nearest(x, x, 5, True)
    part = ann.balanced_partition(neighbours, 8, rng)
    assert np.bincount(part, minlength=8).max() <= 53
    assert (part[neighbours] == part[:, None]).mean() > 0.8
