"""Daily features of stations and markets. Each function takes and returns DataFrames and leaves the plan to Catalyst."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.joins import asof_join, grid_edges, grid_pairs, spot_pairs, spots
from tidewater.operators.windows import change, days_since, last_rows, series, trailing_share
from tidewater.params import SeriesParams
from tidewater.sources.shared import written

KEY = ["station_id", "fuel_type", "market_date"]
SERIES = ["station_id", "fuel_type"]


def daily_ohlc(prices: DataFrame) -> DataFrame:
    """A row a station, fuel and day. Observations at the same time go by price, so that open and close are certain."""
    at = F.struct("observed_at", "price_cpl")
    return prices.groupBy("station_id", "fuel_type", F.col("observed_date").alias("market_date")).agg(
        F.min(at)["price_cpl"].alias("daily_open_price_cpl"),
        F.max(at)["price_cpl"].alias("daily_close_price_cpl"),
        F.min("price_cpl").alias("daily_min_price_cpl"),
        F.max("price_cpl").alias("daily_max_price_cpl"),
        F.count("*").alias("daily_observation_count"),
        F.max("observed_at").alias("last_observed_at"),
    )


def market_median(daily: DataFrame) -> DataFrame:
    """The lower median of the day's closing prices by fuel: a small table, joined back where rows need it."""
    return daily.groupBy("fuel_type", "market_date").agg(F.percentile_approx("daily_close_price_cpl", 0.5, 1_000_000).alias("market_median_price_cpl"))


def competitor_pairs(stations: DataFrame, params: SeriesParams = SeriesParams(), places: int | None = None) -> DataFrame:
    return grid_pairs(stations, "station_id", params.radius_km, places=places).withColumnRenamed("other", "competitor_station_id")


def competitor_edges(stations: DataFrame, params: SeriesParams = SeriesParams(), places: int | None = None) -> DataFrame:
    """competitor_pairs in both directions."""
    return grid_edges(stations, "station_id", params.radius_km, places).withColumnRenamed("other", "competitor_station_id")


@dataclass(frozen=True)
class Near:
    """Who competes, by place: members (spot, station_id) and edges (spot, other, distance_km) between spots in reach, both ways and each with itself.

    All stations of a spot have the same competitors but for themselves; what they share is made once, not for every pair of stations. station_id is a key of stations.
    """

    members: DataFrame
    edges: DataFrame


def competitor_spots(stations: DataFrame, params: SeriesParams = SeriesParams()) -> Near:
    found = spots(stations, "station_id")
    pairs = written(spot_pairs(found, params.radius_km).select("a", "b", "distance_km"), "spot-pairs")
    back = pairs.where("a <> b").select("b", "a", "distance_km")
    return Near(found.select("spot", F.explode("members").alias("station_id")), pairs.union(back).toDF("spot", "other", "distance_km"))


SPOT = ["spot", "fuel_type", "market_date"]


def _by_spot(daily: DataFrame, near: Near, *more: str) -> DataFrame:
    """A row a spot, fuel and day: own (structs of station_id, own_price and more), prices (those that aren't null), their sum, and n, of all rows."""
    rows = daily.select(*KEY, F.col("daily_close_price_cpl").alias("own_price"), *more).join(near.members, "station_id")
    own = rows.groupBy(*SPOT).agg(F.collect_list(F.struct("station_id", "own_price", *more)).alias("own"), F.collect_list("own_price").alias("prices"), F.sum("own_price").alias("sum"), F.count("*").alias("n"))
    return written(own, "spot-days")


def _around(days: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a spot, fuel and day: around (prices of the stations in reach, those of the spot included, in order), their total, and rows, how many they come from."""
    other = days.select(F.col("spot").alias("other"), "fuel_type", "market_date", "prices", "sum", "n")
    found = edges.select("spot", "other").join(other, "other")
    return found.groupBy(*SPOT).agg(F.sort_array(F.flatten(F.collect_list("prices"))).alias("around"), F.sum("sum").alias("total"), F.sum("n").alias("rows"))


def _others(days: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a station, fuel and day that has competitors: own_price, around (the ordered prices in reach, its own included), own_at (where its own stands, null if null), rows (of competitors)."""
    met = days.select(*SPOT, "own").join(_around(days, edges), SPOT)
    rows = met.select("fuel_type", "market_date", "around", "total", (F.col("rows") - 1).alias("rows"), F.inline("own")).where("rows > 0")
    return rows.withColumn("own_at", F.array_position("around", F.col("own_price")) - 1)


def _without_own(k: Column) -> Column:
    """The k-th price in order, from 0, of the competitors alone; null beyond their end."""
    at = F.when(F.col("own_at").isNull() | (k < F.col("own_at")), k).otherwise(k + 1)
    return F.get("around", at.cast("int"))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def competitor_stats(daily: DataFrame, near: Near) -> DataFrame:
    """A row a station, fuel and day with competitors that have a price of that fuel and day. Counted in the ordered prices around its spot; no pair of rows is made."""
    found = _others(_by_spot(daily, near), near.edges)
    n = F.size("around") - F.when(F.col("own_at").isNull(), 0).otherwise(1)
    rows = found.withColumns({"n": n, "below": F.coalesce("own_at", F.lit(0))})
    taken_out = F.aggregate(F.filter("around", lambda x, i: F.col("own_at").isNull() | (i != F.col("own_at"))), F.lit(0.0), lambda s, x: s + x)
    total = F.when(F.col("own_price").isNull(), F.col("total")).when(_finite(F.col("total")), F.col("total") - F.col("own_price")).otherwise(taken_out)
    return rows.select(
        *KEY,
        F.col("n").cast("long").alias("competitor_count"),
        _without_own(F.lit(0)).alias("local_competitor_min_price_cpl"),
        _without_own(F.when(F.col("n") > 0, F.col("n") - 1)).alias("local_competitor_max_price_cpl"),
        _without_own(F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / 2))).alias("local_competitor_median_price_cpl"),
        F.when(F.col("n") > 0, total / F.col("n")).alias("local_competitor_mean_price_cpl"),
        (1 + F.col("below")).alias("rank_within_local_market"),
        (F.col("below") / F.col("rows")).alias("station_price_percentile"),
    )


def cheapest_local(daily: DataFrame, near: Near) -> DataFrame:
    """Stations, fuels and days that no competitor undercuts."""
    return _others(_by_spot(daily, near), near.edges).where(F.col("own_price") <= _without_own(F.lit(0))).select(*KEY)


def rivals_count(daily: DataFrame, near: Near) -> DataFrame:
    """value: how many rows competitor_positioning has."""
    days = daily.join(near.members, "station_id").groupBy(*SPOT).agg(F.count("*").alias("n"))
    other = days.select(F.col("spot").alias("other"), "fuel_type", "market_date", F.col("n").alias("m"))
    met = days.join(near.edges, "spot").join(other, ["other", "fuel_type", "market_date"])
    return met.agg(F.coalesce(F.sum(F.col("n") * (F.col("m") - (F.col("spot") == F.col("other")).cast("int"))), F.lit(0)).alias("value"))


def repeated_rivals(daily: DataFrame, near: Near) -> DataFrame:
    """value: how many keys of competitor_positioning come more than once. Such a key has a station that stands at several spots or has a day twice, so only theirs are looked at."""
    twice = near.members.groupBy("station_id").count().where("count > 1").select("station_id").union(daily.groupBy(*KEY).count().where("count > 1").select("station_id"))
    odd = written(twice.distinct(), "odd-stations")
    rows = near.members.join(odd, "station_id").join(near.edges, "spot").select("station_id", F.col("other").alias("spot"))
    met = rows.join(near.members.withColumnRenamed("station_id", "competitor_station_id"), "spot").where("station_id <> competitor_station_id").select("station_id", "competitor_station_id")
    back = met.join(odd.withColumnRenamed("station_id", "competitor_station_id"), "competitor_station_id", "left_anti").select(F.col("competitor_station_id").alias("station_id"), F.col("station_id").alias("competitor_station_id"))
    found = daily.select(*KEY).join(met.union(back), "station_id").join(daily.select(F.col("station_id").alias("competitor_station_id"), "fuel_type", "market_date"), ["competitor_station_id", "fuel_type", "market_date"])
    return found.groupBy(*KEY, "competitor_station_id").count().agg(F.count_if(F.col("count") > 1).alias("value"))


def station_daily_market(prices: DataFrame, stations: DataFrame, params: SeriesParams = SeriesParams()) -> DataFrame:
    return station_market(daily_ohlc(prices), stations, params)


def station_market(daily: DataFrame, stations: DataFrame, params: SeriesParams = SeriesParams(), colocated: int | None = None, medians: DataFrame | None = None, near: Near | None = None) -> DataFrame:
    """daily beside its market's median and its competitors' prices. daily is read several times: as a written table it is computed once.

    colocated: daily lies in so many buckets by series; what is found of its competitors is dealt likewise, so that neither moves to be joined.
    medians, near: market_median(daily) and competitor_spots(stations), where they are written already: Spark then knows their sizes, and broadcasts what is small.
    """
    stats = competitor_stats(daily, competitor_spots(stations, params) if near is None else near)
    stats = stats.repartition(colocated, *SERIES) if colocated else stats
    out = daily.join(market_median(daily) if medians is None else medians, ["fuel_type", "market_date"]).join(stats, KEY, "left")
    return out.withColumns(
        {
            "price_vs_market_median_cpl": F.col("daily_close_price_cpl") - F.col("market_median_price_cpl"),
            "competitor_count": F.coalesce("competitor_count", F.lit(0)),
            "station_vs_competitor_median_cpl": F.col("daily_close_price_cpl") - F.col("local_competitor_median_price_cpl"),
        }
    )


def _round(x: Column, places: int) -> Column:
    """F.round(x, places), which goes through decimal digits, for the few x that lie by a tie, are large or no number; for all others the nearest whole number of the scaled x gives the same."""
    scaled = x * float(10**places)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - whole) - 0.5) > 1e-6)
    return F.when(plain, whole / float(10**places) + 0.0).otherwise(F.round(x, places))


@F.arrow_udf(T.StructType().add("least", "double").add("second", "double").add("below", T.ArrayType(T.ArrayType(T.IntegerType()))))
def _ordered(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each array of arrays of prices: the two least ones, and for every price how many are below it; all for null. Each price is looked up in the ordered ones, not counted through them."""
    for g in groups:
        inner = g.flatten()
        flat = inner.flatten()
        price, there = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
        within = np.asarray(inner.offsets, np.int64) - inner.offsets[0].as_py()
        rows = np.asarray(g.offsets, np.int64) - g.offsets[0].as_py()
        upto = within[rows]
        below, least = np.zeros(len(price), np.int32), np.full((len(g), 2), np.nan)
        known = np.zeros((len(g), 2), bool)
        for k, (i, j) in enumerate(zip(upto[:-1], upto[1:])):
            order = np.sort(price[i:j][there[i:j]])
            below[i:j] = np.where(there[i:j], np.searchsorted(order, price[i:j]), len(order))
            n = min(2, len(order))
            least[k, :n], known[k, :n] = order[:n], True
        lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.ListArray.from_arrays(pa.array(within.astype(np.int32)), pa.array(below)))
        yield pa.StructArray.from_arrays([*(pa.array(least[:, c], mask=~known[:, c]) for c in (0, 1)), lists], ["least", "second", "below"])


def competitor_positioning(daily: DataFrame, near: Near, stations: DataFrame, places: int | None = None, km_places: int | None = None) -> DataFrame:
    """A row a station, fuel, day and competitor. Ranks are places in the ordered prices around a spot, found once a spot, day and competitor; rows are made where they are returned, and neither moved nor sorted.

    places, km_places: decimal places of prices and distances. These are rounded once a station and day or pair of spots, differences of prices by _round.
    """
    shown = lambda x, n: x if n is None else F.round(x, n)
    brands = daily.join(stations.select("station_id", "brand"), "station_id", "left").withColumn("shown", shown(F.col("daily_close_price_cpl"), places))
    days = _by_spot(brands, near, "brand", "shown")
    other = days.select(F.col("spot").alias("other"), "fuel_type", "market_date", F.col("own").alias("theirs"))
    edges = near.edges.select("spot", "other", shown(F.col("distance_km"), km_places).alias("distance_km"))
    met = edges.join(other.withColumn("prices", F.col("theirs.own_price")).drop("theirs"), "other")
    # Each spot reaches itself; days on which none of its own stations has a price are left out.
    reach = met.groupBy(*SPOT).agg(F.collect_list(F.struct("other", "distance_km", "prices")).alias("reach")).where(F.exists("reach", lambda r: r["other"] == F.col("spot")))
    found = reach.select(*SPOT, F.transform("reach", lambda r: F.struct(r["other"].alias("other"), r["distance_km"].alias("distance_km"))).alias("reach"), _ordered(F.col("reach.prices")).alias("o"))
    # The least price but its own: where its own is the least, the second one, equal or above.
    least = lambda x: F.when(x.isNull() | (x > F.col("o.least")), F.col("o.least")).otherwise(F.col("o.second"))
    cheapest = lambda x: F.named_struct(*(y for c in ("station_id", "own_price", "shown") for y in (F.lit(c), x[c])), F.lit("cheapest"), x["own_price"] <= least(x["own_price"]))
    own = found.join(days.select(*SPOT, "own"), SPOT).select("fuel_type", "market_date", F.transform("own", cheapest).alias("own"), F.col("o.below").alias("below"), F.posexplode("reach").alias("k", "r"))
    # Pairs of spots meet by day; those of their stations are unfolded from them.
    both = own.select("fuel_type", "market_date", "own", F.get("below", "k").alias("below"), "r.*").join(other, ["other", "fuel_type", "market_date"])
    rows = both.select("fuel_type", "market_date", "distance_km", "own", "below", F.posexplode("theirs").alias("k", "t"))
    rows = rows.select("fuel_type", "market_date", "distance_km", "own", F.get("below", "k").alias("below"), *(F.col(f"t.{c}").alias(f"other_{c}") for c in ("station_id", "brand", "own_price", "shown")))
    pairs = rows.select("fuel_type", "market_date", "distance_km", "below", *(f"other_{c}" for c in ("station_id", "brand", "own_price", "shown")), F.inline("own")).where("station_id <> other_station_id")
    mine, theirs = F.col("own_price"), F.col("other_own_price")
    ahead = F.when(theirs.isNull(), mine.isNotNull()).otherwise(F.coalesce(mine < theirs, F.lit(False)))
    return pairs.select(
        *KEY, F.col("other_station_id").alias("competitor_station_id"), F.col("other_brand").alias("competitor_brand"), "distance_km",
        F.col("shown").alias("station_price_cpl"), F.col("other_shown").alias("competitor_price_cpl"), (mine - theirs if places is None else _round(mine - theirs, places)).alias("price_difference_cpl"),
        F.col("cheapest").alias("is_cheapest_local"),
        (F.col("below") + 1 - ahead.cast("int")).cast("long").alias("rank_in_local_market"),
    )


def wholesale_asof(market: DataFrame, wholesale: DataFrame) -> DataFrame:
    """tgp_cpl of the same or the last earlier day, by fuel and day of market; joined on that small grain, not on stations."""
    days = market.select("fuel_type", "market_date").distinct()
    found = asof_join(days, wholesale, ["fuel_type"], "market_date", "tgp_date", ["tgp_cpl"])
    kind = F.when(F.col("matched_on") == F.col("market_date"), "exact_same_day").when(F.col("matched_on").isNotNull(), "latest_prior_date").otherwise("unmatched")
    return found.withColumn("tgp_match_type", kind)


def indicative_margin(daily: DataFrame, wholesale: DataFrame, compat: bool = False, asof: DataFrame | None = None) -> DataFrame:
    """Retail less wholesale price. margin_percentile_30d is null where the margin is; compat counts such rows as lowest instead. asof: wholesale_asof(daily, wholesale), where it is written already."""
    w = series(SERIES, "market_date")
    found = wholesale_asof(daily, wholesale) if asof is None else asof
    m = daily.select(*KEY, F.col("daily_close_price_cpl").alias("retail_price_cpl")).join(found, ["fuel_type", "market_date"])
    m = m.withColumn("indicative_margin_cpl", F.col("retail_price_cpl") - F.col("tgp_cpl"))
    margin = F.col("indicative_margin_cpl")
    share = trailing_share(margin, w, 30)
    if compat:
        n = F.count(margin).over(last_rows(w, 30))
        share = F.coalesce(share, F.when(margin.isNull() & (n != 1), -1.0 / (n - 1)))
    return m.select(
        *KEY, "retail_price_cpl", "tgp_cpl", "tgp_match_type", "indicative_margin_cpl",
        F.when(F.col("tgp_match_type") == "exact_same_day", margin).alias("price_tgp_spread_cpl"),
        (margin - F.avg(margin).over(last_rows(w, 7))).alias("margin_vs_7d_avg_cpl"),
        share.alias("margin_percentile_30d"),
    )


def market_changes(market: DataFrame) -> DataFrame:
    """The market series: fuel, day, median and its change from the last day that has one."""
    days = market.select("fuel_type", "market_date", "market_median_price_cpl").distinct()
    return days.withColumn("market_daily_change_cpl", change(F.col("market_median_price_cpl"), series(["fuel_type"], "market_date")))


def market_days(market: DataFrame, holidays: DataFrame) -> DataFrame:
    """What a fuel's day has of its own: the change of the market, and whether it is a holiday. A small table."""
    free = holidays.select(F.col("holiday_date").alias("market_date"), F.lit(True).alias("is_public_holiday")).distinct()
    return market_changes(market).select("fuel_type", "market_date", "market_daily_change_cpl").join(free, "market_date", "left")


def market_cycle_features(market: DataFrame, margin: DataFrame, holidays: DataFrame, params: SeriesParams = SeriesParams(), days: DataFrame | None = None) -> DataFrame:
    """Trailing features of every series, all over one partitioning by station and fuel. days: market_days(market, holidays), where it is written already."""
    w = series(SERIES, "market_date")
    close, w7, w14 = F.col("daily_close_price_cpl"), last_rows(w, 7), last_rows(w, 14)
    base = market.select(*KEY, "daily_close_price_cpl", "market_median_price_cpl").join(margin.select(*KEY, "indicative_margin_cpl", "tgp_cpl"), KEY, "left")
    base = base.join(market_days(market, holidays) if days is None else days, ["fuel_type", "market_date"])
    rolled = base.withColumns(
        {
            "rolling_7d_min_price": F.min(close).over(w7),
            "rolling_7d_max_price": F.max(close).over(w7),
            "rolling_7d_mean_price": F.avg(close).over(w7),
            "rolling_7d_std_price": F.stddev(close).over(w7),
            "rolling_14d_min_price": F.min(close).over(w14),
            "rolling_14d_max_price": F.max(close).over(w14),
            "rolling_14d_price_change_cpl": change(close, w, 14),
            "own_daily_change_cpl": change(close, w),
            "tgp_7d_change_cpl": change(F.col("tgp_cpl"), w, 7),
            "margin_compression_cpl": F.avg("indicative_margin_cpl").over(w7) - F.col("indicative_margin_cpl"),
        }
    )
    low, high, day = F.col("rolling_14d_min_price"), F.col("rolling_14d_max_price"), F.col("market_date")
    marked = rolled.withColumns({"_low": F.when(close == low, day), "_jump": F.when(F.col("own_daily_change_cpl") >= params.jump, day)})
    return marked.select(
        *KEY, "rolling_7d_min_price", "rolling_7d_max_price", "rolling_7d_mean_price", "rolling_7d_std_price", "rolling_14d_min_price", "rolling_14d_max_price", "rolling_14d_price_change_cpl",
        days_since(F.col("_low"), day, w).cast("long").alias("days_since_local_minimum"),
        days_since(F.col("_jump"), day, w).cast("long").alias("days_since_last_detected_jump"),
        F.when(high > low, (close - low) / (high - low)).alias("price_position_within_14d_range"),
        "market_median_price_cpl", "market_daily_change_cpl", "tgp_7d_change_cpl", "margin_compression_cpl",
        F.dayofweek(day).cast("long").alias("day_of_week"), F.coalesce("is_public_holiday", F.lit(False)).alias("is_public_holiday"),
    )


def daily_pricing_inputs(market: DataFrame, margin: DataFrame, cycle: DataFrame) -> DataFrame:
    """The model's inputs: features only, never labels."""
    cycle = cycle.drop("market_median_price_cpl", "market_daily_change_cpl")
    kept = market.drop("daily_open_price_cpl", "daily_min_price_cpl", "daily_max_price_cpl", "daily_observation_count", "last_observed_at", "price_vs_market_median_cpl", "local_competitor_mean_price_cpl")
    return kept.join(cycle, KEY, "left").join(margin.select(*KEY, "tgp_cpl", "indicative_margin_cpl"), KEY, "left")


def jump_labels(market: DataFrame, params: SeriesParams = SeriesParams()) -> DataFrame:
    """Targets: they look ahead by design and are never joined into features."""
    w = series(["fuel_type"], "market_date")
    flagged = market_changes(market).withColumn("jump_today", F.coalesce(F.col("market_daily_change_cpl") >= params.jump, F.lit(False)))
    ahead = lambda n: F.lead("jump_today", n).over(w)
    return flagged.withColumns({"jump_within_24h": ahead(1), "jump_within_48h": F.coalesce(ahead(1), F.lit(False)) | F.coalesce(ahead(2), F.lit(False))})
