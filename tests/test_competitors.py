"""Competitors by place: a crowd at one spot makes no pairs of stations, and the figures are those of all pairs."""

import random
from datetime import date

from pyspark.sql import functions as F

from tidewater.functions.geo import arc_km
from tidewater.plans import features as P


def market(spark):
    rng = random.Random(6)
    places = [(-33.85, 151.05)] * 300 + [(-33.9 + 0.1 * rng.random(), 151 + 0.1 * rng.random()) for _ in range(25)] + [(-30.0, 150.0), (None, 151.0)]
    stations = [(f"s{i:03d}", a, b, f"b{i % 3}") for i, (a, b) in enumerate(places)]
    prices = [(s[0], fuel, date(2024, 1, 1 + d), None if rng.random() < 0.1 else float(rng.randrange(150, 180))) for s in stations for fuel in "AB" for d in range(2) if rng.random() < (0.9 if fuel == "A" else 0.05)]
    daily = spark.createDataFrame(prices, "station_id string, fuel_type string, market_date date, daily_close_price_cpl double")
    return daily, spark.createDataFrame(stations, "station_id string, latitude double, longitude double, brand string")


def brute(daily, stations):
    """(own, competitor) by key, of all pairs of stations."""
    a, b = stations.select("station_id", "latitude", "longitude"), stations.toDF("c", "p", "q", "brand")
    km = arc_km(F.col("latitude"), F.col("longitude"), F.col("p"), F.col("q"))
    near = [(r.station_id, r.c) for r in a.crossJoin(b).where((F.col("station_id") != F.col("c")) & (F.abs(F.col("latitude") - F.col("p")) <= 0.06) & (F.abs(F.col("longitude") - F.col("q")) <= 0.07) & (km <= 5)).collect()]
    by = {}
    for r in daily.collect():
        by.setdefault(r.station_id, {})[r.fuel_type, r.market_date] = r.daily_close_price_cpl
    out = {}
    for s, c in near:
        for k, p in by.get(s, {}).items():
            if k in by.get(c, {}):
                out.setdefault((s, *k), (p, {}))[1][c] = by[c][k]
    return out


def test_figures_are_those_of_all_pairs(spark):
    daily, stations = market(spark)
    near = P.competitor_spots(stations)
    assert near.edges.count() < 40 * 40 < 300 * 299  # of places, not of stations
    want = brute(daily, stations)
    got = {(r.station_id, r.fuel_type, r.market_date): r for r in P.competitor_stats(daily, near).collect()}
    assert got.keys() == want.keys()
    for k, (own, others) in want.items():
        p, r = sorted(x for x in others.values() if x is not None), got[k]
        below = sum(x < own for x in p) if own is not None else 0
        assert (r.competitor_count, r.rank_within_local_market, r.station_price_percentile) == (len(p), 1 + below, below / len(others))
        assert (r.local_competitor_min_price_cpl, r.local_competitor_max_price_cpl, r.local_competitor_median_price_cpl) == ((p[0], p[-1], p[(len(p) - 1) // 2]) if p else (None, None, None))
        assert (abs(r.local_competitor_mean_price_cpl - sum(p) / len(p)) < 1e-9) if p else r.local_competitor_mean_price_cpl is None
    cheapest = {k for k, (own, o) in want.items() if own is not None and any(x is not None for x in o.values()) and own <= min(x for x in o.values() if x is not None)}
    assert {tuple(r) for r in P.cheapest_local(daily, near).collect()} == cheapest


def test_rows_of_all_pairs(spark):
    daily, stations = market(spark)
    near, want = P.competitor_spots(stations), brute(daily, stations)
    rows = P.competitor_positioning(daily, near, stations).collect()
    assert len(rows) == sum(len(o) for _, o in want.values()) == P.rivals_count(daily, near).first().value
    for r in rows[::97]:
        own, others = want[r.station_id, r.fuel_type, r.market_date]
        price, p = others[r.competitor_station_id], [x for x in others.values() if x is not None]
        assert (r.station_price_cpl, r.competitor_price_cpl) == (own, price) and r.competitor_brand == f"b{int(r.competitor_station_id[1:]) % 3}"
        assert r.rank_in_local_market == 1 + (sum(x < price for x in p) if price is not None else len(p))
        assert r.is_cheapest_local == (own <= min(p) if p and own is not None else None)
    assert P.repeated_rivals(daily, near).first().value == 0
    again = daily.union(daily.where("station_id = 's000' and fuel_type = 'A' and market_date = '2024-01-01'"))
    mine = [k for k in want if k[1:] == ("A", date(2024, 1, 1)) and (k[0] == "s000" or "s000" in want[k][1])]
    assert P.repeated_rivals(again, near).first().value == sum(len(want[k][1]) if k[0] == "s000" else 1 for k in mine)


def test_both_directions_without_a_row_for_each_in_between(spark):
    """Places are turned round before pairs are unfolded: each edge comes once, and no plan step turns pairs of stations."""
    _, stations = market(spark)
    pairs, edges = P.competitor_pairs(stations, places=3), P.competitor_edges(stations, places=3)
    one, both = [tuple(r) for r in pairs.collect()], [tuple(r) for r in edges.collect()]
    assert len(both) == len(set(both)) == 2 * len(one) and set(both) == {*one, *((b, a, d) for a, b, d in one)}
    assert len(one) > 300 * 299 / 2 and all(a < b and d == round(d, 3) for a, b, d in one)


def test_rounding_is_that_of_round(spark):
    rng = random.Random(2)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -0.00001, 1e300, -1e17, 0.00005, 0.00015, 1.00005, -2.00025, 0.1 + 0.2, 123456.78905, 2.675, 4e5 + 0.00005]
    values += [rng.uniform(-300, 300) for _ in range(3000)] + [rng.randrange(-60000, 60000) / 20000 for _ in range(3000)] + [(rng.randrange(9**9) + 0.5) / 10**4 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 4).alias("want"), P._round(F.col("x"), 4).alias("got"))
    assert [(str(r.x), str(r.want)) for r in rows.collect()] == [(str(r.x), str(r.got)) for r in rows.collect()]


def test_prices_are_looked_up_not_counted_through(spark):
    """A price's place among n in reach takes no walk through them for each pair, and digits of prices are rounded before pairs are made."""
    daily, stations = market(spark)
    rows = P.competitor_positioning(daily, P.competitor_spots(stations), stations, 4, 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
    assert all("round(" not in line.replace("round((own_price", "") for line in plan[: plan.index("Generate")].splitlines())
    nan = float("nan")
    groups = [[[3.0, None, 1.0], [2.0, 1.0], []], [[None]], [], [[nan, 5.0], [-0.0, 0.0, nan]]]
    got = [r.o for r in spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, g array<array<double>>").coalesce(1).select("i", P._ordered("g").alias("o")).orderBy("i").collect()]
    assert [(r.least, r.second) for r in got[:3]] == [(1.0, 1.0), (None, None), (None, None)] and (got[3].least, got[3].second) == (0.0, 0.0)
    assert [r.below for r in got] == [[[3, 4, 0], [2, 0], []], [[0]], [], [[3, 2], [0, 0, 3]]]
    shown = {(r.station_id, r.fuel_type, r.market_date, r.competitor_station_id): r for r in rows.collect()}
    plain = P.competitor_positioning(daily, P.competitor_spots(stations), stations).collect()
    assert len(shown) == len(plain) > 90_000
    for r in plain[::53]:
        s = shown[r.station_id, r.fuel_type, r.market_date, r.competitor_station_id]
        assert s.rank_in_local_market == r.rank_in_local_market and s.distance_km == round(r.distance_km, 3) and (s.is_cheapest_local, s.price_difference_cpl) == (r.is_cheapest_local, r.price_difference_cpl)
