import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.geo import arc_km
from tidewater.operators import joins as J
from tidewater.operators import ordered as O
from tidewater.plans import decisions as D


def rows_by_task(df):
    return df.groupBy(F.spark_partition_id()).count().toPandas()["count"]


def test_prefix_sums_of_a_hot_key(spark):
    """Half of the rows have one key; its sums go on over ranges, null keys and ties included."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(400), rng.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, n int").groupBy("k", "o").agg(F.sum("n").alias("n"))
    for order, sign in ((["o"], 1), ([F.desc("o")], -1)):
        got = {(r.k, r.o): r.s for r in O.with_prefix_sums(df, ["k"], order, {"s": "n"}, ranges=7).collect()}
        assert got == {(k, o): sum(n for a, b, n in rows if a == k and sign * b <= sign * o) for k, o in {(a, b) for a, b, _ in rows}}
    assert O.with_prefix_sums(df.where("k = 'none'"), ["k"], ["o"], {"s": "n"}).count() == 0


def test_average_precision_of_ten_million_scores(spark):
    """All of one fuel, all distinct: many tasks, none with more than its share; the digits of one pass in numpy."""
    n = 10_000_000
    scores = spark.range(n).select(F.lit("U91").alias("fuel_type"), ((F.col("id") * 7919) % n / n).alias("probability"), (F.xxhash64("id") % 10 == 0).alias("actual"))
    got = D.average_precision(scores, ranges=16).first().average_precision
    p = scores.select("probability", "actual").toArrow()
    actual = np.asarray(p["actual"].to_numpy())[np.argsort(-p["probability"].to_numpy())]
    want = (np.cumsum(actual)[actual] / (np.flatnonzero(actual) + 1)).sum() / actual.sum()
    assert abs(got - want) < 1e-12
    tasks = rows_by_task(O.in_ranges(scores.select("fuel_type", "probability"), ["fuel_type"], [F.desc("probability")], 16))
    ranges = O.in_ranges(scores.select("fuel_type", "probability"), ["fuel_type"], [F.desc("probability")], 16).groupBy("_range").count().toPandas()["count"]
    assert len(ranges) == 16 and ranges.max() < 2 * n / 16 and tasks.sum() == n


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_asof_join_over_ranges(spark, ranges):
    rng = random.Random(2)
    right = {(rng.choice(["hot", "a"]), rng.randrange(500)): rng.random() for _ in range(150)}
    right |= {("late", 499): 1.0, ("early", -5): 2.0}
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "late", "early", "none", None]), rng.choice([*range(500), None])) for i in range(1500)]
    l = spark.createDataFrame(left, "i int, k string, at int")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()] + [(None, 3, 9.0), ("a", None, 9.0)], "k string, t int, v double")
    got = {x.i: (x.k, x.at, x.matched_on, x.v) for x in J.asof_join(l, r, ["k"], "at", "t", ["v"], ranges).collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        found = max(((t, v) for (kk, t), v in right.items() if kk == k and at is not None and t <= at), default=(None, None))
        assert got[i] == (k, at, *found), i


def test_a_value_that_is_there_but_holds_null(spark):
    """The last row counts, whatever its values."""
    l, r = spark.createDataFrame([("a", 5)], "k string, at int"), spark.createDataFrame([("a", 1, 1.0), ("a", 4, None)], "k string, t int, v double")
    assert tuple(J.asof_join(l, r, ["k"], "at", "t", ["v"]).first()) == ("a", 5, 4, None)


def brute(points, radius, lat=0.06, lon=0.07):
    rows = points.collect()
    a = np.array([(p.latitude, p.longitude) for p in rows])
    rad = np.radians(a)
    out = set()
    for i in range(len(rows)):
        cos = np.cos(rad[i, 0]) * np.cos(rad[:, 0]) * np.cos(rad[:, 1] - rad[i, 1]) + np.sin(rad[i, 0]) * np.sin(rad[:, 0])
        near = (6371.0 * np.arccos(np.clip(cos, -1, 1)) <= radius) & (abs(a[:, 0] - a[i, 0]) <= lat) & (abs(a[:, 1] - a[i, 1]) <= lon)
        out |= {(rows[i].k, rows[j].k) for j in np.flatnonzero(near) if rows[i].k < rows[j].k}
    return out


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_tiles_find_all_pairs(spark, tile):
    """Spread points, a crowd at one place, others near a pole, across cells and without a place."""
    rng = random.Random(3)
    pts = [(-33.9 + 0.2 * rng.random(), 151 + 0.2 * rng.random()) for _ in range(300)] + [(-33.85, 151.05)] * 40 + [(89.97 + 0.02 * rng.random(), 0.1 * rng.random()) for _ in range(30)] + [(0.0, 0.0), (0.0, 0.01), (0.059, 0.0)]
    rows = [(f"s{i:03d}", a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame([*rows, ("n1", None, 151.0), ("n2", -33.9, None)], "k string, latitude double, longitude double")
    got = J.grid_pairs(df, "k", 5.0, tile_points=tile)
    pairs = [(r.k, r.other) for r in got.collect()]
    assert set(pairs) == brute(df.where("latitude is not null and longitude is not null"), 5.0) and len(pairs) == len(set(pairs))
    assert J.grid_pairs(df.where("k = 'none'"), "k", 5.0).count() == 0


def test_a_hundred_thousand_points_in_one_cell(spark):
    """A radius far smaller than the cell: no task has more than a small share of the comparisons, and the pairs are those of a finer grid."""
    rows = spark.range(100_000).select(F.col("id").alias("k"), (-33.9 + 0.05 * ((F.xxhash64("id") % 10_007) / 10_007 + 1) / 2).alias("latitude"), (151.0 + 0.06 * ((F.xxhash64("id", F.lit(1)) % 10_007) / 10_007 + 1) / 2).alias("longitude"))
    assert rows.select(F.floor(F.col("latitude") / 0.06), F.floor(F.col("longitude") / 0.07)).distinct().count() <= 2
    tiled = J.tiles(rows, "k", 0.06, 0.07)
    n = tiled.groupBy("tile").count().withColumnRenamed("count", "n").cache()
    pairs = J.tile_pairs(tiled, 0.05, 0.06, 0.07)
    work = pairs.join(n.select(F.col("tile").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("tile").alias("b"), F.col("n").alias("nb")), "b").select((F.col("na") * F.col("nb")).alias("w"))
    most, total = work.agg(F.max("w"), F.sum("w")).first()
    assert most < total / 500 and total < 0.05 * 1e10
    got = J.grid_pairs(rows, "k", 0.05).select("k", "other")
    cells = rows.withColumns({"y": F.floor(F.col("latitude") / 0.0005), "x": F.floor(F.col("longitude") / 0.0007)})
    around = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    a = cells.select("k", "latitude", "longitude", F.inline(around))
    b = cells.select(F.col("k").alias("other"), F.col("latitude").alias("p"), F.col("longitude").alias("q"), "y", "x")
    want = a.join(b, ["y", "x"]).where("k < other").where(arc_km(F.col("latitude"), F.col("longitude"), F.col("p"), F.col("q")) <= 0.05).select("k", "other")
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0
    n.unpersist()
