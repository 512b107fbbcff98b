import numpy as np
import pytest

from tidewater.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, root int, q string"


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(root[a], root[b])
            moved |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {i: (links[i], root[i]) for i, _ in rows}


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_against_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(E, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(E, "TILE_ROWS", 32)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in [1] * 60 + [2, 3, 5, 8, 120]:
        x = rng.normal(size=16)
        for _ in range(size):
            rows.append(((n * 37) % 1009, [float(np.float32(v)) for v in x + rng.normal(size=16) * rng.uniform(0, 0.35)]))
            n += 1
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (2004, []), (2005, [1.0, 0.0]), (2006, [2.0, 0.1]), (None, rows[0][1]), (2007, [float("inf")] + [1.0] * 15), (2008, [1e30] * 16), (2009, [1e-30] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert got[2005] == (1, 2005) and got[2009] == (1, 2008) and got[None] == (0, None)


def test_repeated_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(5, v, 0, "", 0, ""), (5, v, 0, "", 0, ""), (7, v, 0, "", 0, "")], SCHEMA)
    assert [tuple(r) for r in E.near_duplicates(df).orderBy("vec_id").collect()] == [(5, 2, 5, True)] * 2 + [(7, 2, 5, False)]
    assert E.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]) * scale[:, None]
    err = np.linalg.norm(x - q, axis=1)
    assert (np.abs(x @ x.T - q @ q.T) <= err[:, None] + (1 + err[:, None]) * err + 1e-12).all()
