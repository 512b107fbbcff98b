import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, sid int, target int, part int, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    fixed = set()
    while over := {s for s in names if s not in fixed and target[s] > 3 * sizes[s] + 1e-9}:
        fixed |= over
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        free = sum(weight[s] for s in names if s not in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / free for s in names}
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takings(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    monkeypatch.setattr(mixing, "ROWS_IN_ORDER", 20)
    rng = random.Random(seed)
    rows = [(i, " \t".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 90]))), rng.choice(["a", "B", "é", None, "hot", "hot", "hot", "z"])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, "one", "tiny"), (None, "x y z", "a"), (5, "same id", "a"), (903, "w " * 4000, "z")]
    got = mixing.mixed(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    source = {i: s for i, _, s in rows if i not in (5, None)}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id in source:
            assert (r.source_size, r.target) == (sizes[source[r.doc_id]], pytest.approx(want[source[r.doc_id]]))
            taken[source[r.doc_id]] += r.taken
    for s in want:
        if s != "a":
            assert abs(taken[s] - want[s]) <= 4 * 3 + 0.1 * want[s], s
    again = mixing.mixed(frame(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_a_block_comes_again_only_after_all_others(spark):
    sources = spark.createDataFrame([(0, "a", 3200, 8000.0), (1, "b", 100, 40.0)], "sid long, source string, source_size long, target double")
    counts = Counter(r.block for r in mixing.slots(sources).where("sid = 0").collect())
    assert set(counts) == set(range(100)) and set(counts.values()) == {2, 3}


def test_stage_and_empty(spark):
    rows = [(i, "a b c", "s") for i in range(60)] + [(100 + i, "a b c", "t") for i in range(60)] + [(None, "a b", "t"), (7000, None, "t")]
    docs = frame(spark, rows)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    by = Counter(r.source for r in out.collect())
    assert abs(by["s"] - 86) <= 9 and abs(by["t"] - 34) <= 9
    empty = docs.where(F.lit(False))
    assert mixing.mixed(empty).count() == 0 and mixing.stage(spark, empty, "").count() == 0
    assert [r.taken for r in mixing.mixed(docs.where("doc_id = 7000")).collect()] == [0]
