import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, score string, _predicted int, _0 int"


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = L.Network.fresh(["a", "b", "c"], rng)
    net.out[:], net.bias[:] = rng.normal(size=net.out.shape), rng.normal(size=3)
    for k in ("w", "u", "out", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(97, 103, size=(9, 5)).astype(np.uint8), rng.integers(3, size=5)

    def loss():
        p = net.probabilities(x)
        return -np.log(p[:, y, np.arange(5)]).mean()

    for name, g in zip(("w", "u", "out", "bias"), net.gradients(x, y)):
        weights = getattr(net, name)
        for _ in range(25):
            at = tuple(rng.integers(n) for n in weights.shape)
            if name == "w":
                at = (at[0], rng.integers(97, 103), at[2])
            old, e = weights[at], 1e-4
            weights[at] = old + e
            up = loss()
            weights[at] = old - e
            down = loss()
            weights[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_pooling_is_the_mean_over_all_positions(monkeypatch):
    rng = np.random.default_rng(1)
    net = L.Network.fresh(["a", "b"], rng)
    net.out[:] = rng.normal(size=net.out.shape)
    monkeypatch.setattr(L, "LANES", 3)
    texts = ["", "x", "é" * 40, "long text " * 50, "y" * L.WINDOW]
    got = L.pooled(net, texts)
    for t, p in zip(texts, got):
        raw = np.frombuffer(t.encode(), np.uint8)
        each = [net.probabilities(raw[i : i + L.WINDOW, None])[:, :, 0] for i in range(0, len(raw), L.WINDOW)]
        assert p == pytest.approx(np.concatenate(each).mean(axis=0) if each else [0, 0], abs=1e-5)


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(L, "STEPS", 150)


def test_held_out_accuracy(spark, quick):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = L.network(docs, ~L.held_out())
    out = L.labelled(docs, net).where(L.held_out())
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_rows(spark, quick):
    rows = [(i, "the cat and the dog of house number " * 5, "en") for i in range(40)] + [(100 + i, "der hund und die katze über haus " * 5, "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !!! ###", "de"), (503, "the dog and the cat " * 20_000, None), (503, "the dog and the cat " * 20_000, None), (None, "und der hund", None), (504, "und", "de")]
    docs = spark.createDataFrame([(*r, "s", "x", 1, 2) for r in rows], SCHEMA)
    net = L.network(docs, ~F.coalesce(L.held_out(), F.lit(True)))
    assert net.labels == ["de", "en"]
    got = {(r.doc_id, r.lang_pred) for r in L.labelled(docs.select("doc_id", "text"), net).collect()}
    assert {(500, "und"), (501, "und"), (502, "und"), (503, "en"), (None, "de"), (3, "en"), (103, "de")} <= got
    out = L.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} - {500, 501, 502}
    empty = docs.where(F.lit(False))
    assert L.network(empty, F.lit(True)) is None and L.stage(spark, empty, "").count() == 0
    assert {r.lang_pred for r in L.labelled(docs.select("text"), None).collect()} == {"und"}


def test_learns_every_label(spark, monkeypatch):
    """Also those beyond the 64 commonest."""
    seen = {}
    monkeypatch.setattr(L, "trained", lambda texts, labels: seen.update(rows=list(zip(texts, labels))))
    rows = [(i, f"text {i} of {i % 90}", f"l{i % 90}") for i in range(1800)] + [(9999, "a lone text", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    L.network(docs, F.lit(True))
    assert {x for _, x in seen["rows"]} == {x for _, _, x in rows}
    assert len(seen["rows"]) == len(rows)
