"""Queries on prices, markets, margins and cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.windows import series
from tidewater.plans import features as P
from tidewater.plans.gold import commit_gold
from tidewater.queries_sql import rounded, with_
from tidewater.sources import events as E
from tidewater.sources.shared import new_path, own_database, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = P.KEY


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_(sql)
        return f

    return register


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_ohlc(E.prices(spark, sf_dir))


def shared_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily for plans that read it more than once: a table in the shared folder, which no other query sees."""
    return written(daily(spark, sf_dir), "daily")


def gold(spark: SparkSession, sf_dir: str, *only: str) -> dict[str, DataFrame]:
    """Feature tables committed in a database of their own, bucketed by series."""
    e = E.prices(spark, sf_dir), E.stations(spark, sf_dir), E.wholesale(spark, sf_dir), E.holidays(spark)
    return commit_gold(spark, *e, own_database(spark), new_path(spark, "gold"), only=only)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.station_market(shared_daily(spark, sf_dir), E.stations(spark, sf_dir))


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.indicative_margin(shared_daily(spark, sf_dir), E.wholesale(spark, sf_dir))


def cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shared_daily(spark, sf_dir)
    return P.market_cycle_features(d.join(P.market_median(d), ["fuel_type", "market_date"]), P.indicative_margin(d, E.wholesale(spark, sf_dir)), E.holidays(spark))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_pricing_inputs over the committed tables of its series: no table moves to be joined."""
    t = gold(spark, sf_dir, "station_daily_market", "indicative_margin", "market_cycle_features")
    return P.daily_pricing_inputs(t["station_daily_market"], t["indicative_margin"], t["market_cycle_features"])


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.market_changes(P.market_median(daily(spark, sf_dir)))


OHLC = ["daily_open_price_cpl", "daily_close_price_cpl", "daily_min_price_cpl", "daily_max_price_cpl"]


@query(f"select station_id, fuel_type, market_date, {rounded(OHLC)}, daily_observation_count, last_observed_at from daily")
def daily_ohlc(spark, sf_dir):
    return round_doubles(daily(spark, sf_dir))


@query("select fuel_type, market_date, round(market_median_price_cpl, 4) market_median_price_cpl from med")
def market_median(spark, sf_dir):
    return round_doubles(P.market_median(daily(spark, sf_dir)))


@query("select fuel_type, market_date, round(quantile_cont(daily_close_price_cpl, 0.5), 4) market_median_price_cpl from daily group by 1, 2")
def market_median_interp(spark, sf_dir):
    return round_doubles(daily(spark, sf_dir).groupBy("fuel_type", "market_date").agg(F.percentile("daily_close_price_cpl", 0.5).alias("market_median_price_cpl")))


@query("select station_id, fuel_type, market_date, round(percent_rank() over (partition by fuel_type, market_date order by daily_close_price_cpl), 6) price_rank from daily")
def market_rank(spark, sf_dir):
    w = Window.partitionBy("fuel_type", "market_date").orderBy("daily_close_price_cpl")
    return daily(spark, sf_dir).select(*KEY, F.round(F.percent_rank().over(w), 6).alias("price_rank"))


@query("select station_id, competitor_station_id, round(distance_km, 3) distance_km from pairs")
def competitor_pairs(spark, sf_dir):
    return P.competitor_pairs(E.stations(spark, sf_dir), places=3)


@query("select station_id, competitor_station_id, round(distance_km, 3) distance_km from edges")
def symmetric_edges(spark, sf_dir):
    return P.competitor_edges(E.stations(spark, sf_dir), places=3)


STATS = ["local_competitor_min_price_cpl", "local_competitor_max_price_cpl", "local_competitor_median_price_cpl", "local_competitor_mean_price_cpl", "station_price_percentile"]


@query(f"select station_id, fuel_type, market_date, competitor_count, rank_within_local_market, {rounded(STATS, 8)} from cstats")
def competitor_stats(spark, sf_dir):
    return round_doubles(P.competitor_stats(shared_daily(spark, sf_dir), P.competitor_spots(E.stations(spark, sf_dir))), 8)


@query(f"select station_id, fuel_type, market_date, {rounded(OHLC + STATS + ['market_median_price_cpl', 'price_vs_market_median_cpl', 'station_vs_competitor_median_cpl'], 8)}, daily_observation_count, last_observed_at, competitor_count, rank_within_local_market from market")
def station_daily_market(spark, sf_dir):
    return round_doubles(market(spark, sf_dir), 8)


@query("""select r.station_id, fuel_type, market_date, competitor_station_id, s.brand competitor_brand, round(distance_km, 3) distance_km, round(own_price, 4) station_price_cpl, round(competitor_price, 4) competitor_price_cpl,
    round(own_price - competitor_price, 4) price_difference_cpl, own_price <= min(competitor_price) over (partition by r.station_id, fuel_type, market_date) is_cheapest_local,
    rank() over (partition by r.station_id, fuel_type, market_date order by competitor_price) rank_in_local_market from rivals r left join stations s on s.station_id = r.competitor_station_id""")
def competitor_positioning(spark, sf_dir):
    s = E.stations(spark, sf_dir)
    return P.competitor_positioning(shared_daily(spark, sf_dir), P.competitor_spots(s), s, places=4, km_places=3)


@query("select distinct station_id, fuel_type, market_date from rivals r where own_price <= (select min(competitor_price) from rivals x where x.station_id = r.station_id and x.fuel_type = r.fuel_type and x.market_date = r.market_date)")
def cheapest_local(spark, sf_dir):
    return P.cheapest_local(shared_daily(spark, sf_dir), P.competitor_spots(E.stations(spark, sf_dir)))


@query("select d.station_id, d.fuel_type, d.market_date, round(t.tgp_cpl, 4) tgp_cpl from daily d left join tgp t on t.fuel_type = d.fuel_type and t.tgp_date = d.market_date")
def tgp_exact(spark, sf_dir):
    t = E.wholesale(spark, sf_dir).withColumnRenamed("tgp_date", "market_date")
    return round_doubles(daily(spark, sf_dir).select(*KEY).join(t, ["fuel_type", "market_date"], "left").select(*KEY, "tgp_cpl"))


@query("select fuel_type, market_date, matched_on, round(tgp_cpl, 4) tgp_cpl, tgp_match_type from asofs")
def tgp_asof(spark, sf_dir):
    return round_doubles(P.wholesale_asof(daily(spark, sf_dir), E.wholesale(spark, sf_dir)))


MARGIN = ["retail_price_cpl", "tgp_cpl", "indicative_margin_cpl", "price_tgp_spread_cpl", "margin_vs_7d_avg_cpl", "margin_percentile_30d"]


@query(f"select station_id, fuel_type, market_date, tgp_match_type, {rounded(MARGIN)} from margin")
def indicative_margin(spark, sf_dir):
    return round_doubles(margin(spark, sf_dir))


@query("select station_id, fuel_type, market_date, round(margin_vs_7d_avg_cpl, 4) margin_vs_7d_avg_cpl from margin where margin_vs_7d_avg_cpl is not null")
def margin_vs_7d(spark, sf_dir):
    return round_doubles(margin(spark, sf_dir).select(*KEY, "margin_vs_7d_avg_cpl").where("margin_vs_7d_avg_cpl is not null"))


@query("""select m.station_id, m.fuel_type, m.market_date, round(coalesce(s.margin_percentile_30d, case when m.indicative_margin_cpl is null and n <> 1 then -1.0::double / (n - 1) end), 4) margin_percentile_30d
    from (select *, count(indicative_margin_cpl) over (partition by station_id, fuel_type order by market_date rows between 29 preceding and current row) n from margin0) m join share s using (station_id, fuel_type, market_date)""")
def margin_percentile_30d_compat(spark, sf_dir):
    out = P.indicative_margin(daily(spark, sf_dir), E.wholesale(spark, sf_dir), compat=True)
    return round_doubles(out.select(*KEY, "margin_percentile_30d"))


CYCLE = ["rolling_7d_min_price", "rolling_7d_max_price", "rolling_7d_mean_price", "rolling_7d_std_price", "rolling_14d_min_price", "rolling_14d_max_price", "rolling_14d_price_change_cpl", "price_position_within_14d_range", "tgp_7d_change_cpl", "margin_compression_cpl"]


@query(f"select station_id, fuel_type, market_date, {rounded(CYCLE + ['market_median_price_cpl', 'market_daily_change_cpl'], 8)}, days_since_local_minimum, days_since_last_detected_jump, day_of_week, is_public_holiday from cycle")
def market_cycle_features(spark, sf_dir):
    return round_doubles(cycle(spark, sf_dir), 8)


INPUTS = CYCLE + STATS[:3] + ["daily_close_price_cpl", "market_median_price_cpl", "station_price_percentile", "station_vs_competitor_median_cpl", "tgp_cpl", "indicative_margin_cpl"]


@query(f"select station_id, fuel_type, market_date, rank_within_local_market, competitor_count, days_since_local_minimum, days_since_last_detected_jump, day_of_week, is_public_holiday, {rounded(INPUTS, 8)} from (select m.*, c.* exclude (station_id, fuel_type, market_date, market_median_price_cpl), i.tgp_cpl, i.indicative_margin_cpl from market m left join cycle c using (station_id, fuel_type, market_date) left join margin i using (station_id, fuel_type, market_date)) x")
def daily_pricing_inputs(spark, sf_dir):
    return round_doubles(inputs(spark, sf_dir), 8)


@query("select fuel_type, market_date, round(market_median_price_cpl, 4) market_median_price_cpl, round(market_daily_change_cpl, 4) market_daily_change_cpl, jump_today, jump_within_24h, jump_within_48h from labels")
def jump_labels(spark, sf_dir):
    return round_doubles(P.jump_labels(P.market_median(daily(spark, sf_dir))))


@query("select fuel_type, market_date, round(market_median_price_cpl, 4) market_median_price_cpl, round(market_daily_change_cpl, 4) market_daily_change_cpl from changes")
def lag_change(spark, sf_dir):
    return round_doubles(changes(spark, sf_dir))


@query("select market_date, max(dayofweek(market_date) + 1) day_of_week, max(case when h.holiday_date is not null then 1 else 0 end)::int is_holiday, round(avg(t.tgp_cpl), 4) avg_tgp from daily d left join hol h on h.holiday_date = d.market_date left join tgp t on t.fuel_type = d.fuel_type and t.tgp_date = d.market_date group by 1")
def market_context(spark, sf_dir):
    d = daily(spark, sf_dir).join(E.wholesale(spark, sf_dir).withColumnRenamed("tgp_date", "market_date"), ["fuel_type", "market_date"], "left")
    d = d.join(E.holidays(spark).select(F.col("holiday_date").alias("market_date"), F.lit(1).alias("_h")).distinct(), "market_date", "left")
    return round_doubles(d.groupBy("market_date").agg(F.max(F.dayofweek("market_date").cast("long")).alias("day_of_week"), F.max(F.coalesce("_h", F.lit(0))).alias("is_holiday"), F.avg("tgp_cpl").alias("avg_tgp")))


@query("""select a.fuel_type, b.fuel_type other_fuel, count(*) as days, round(avg(a.market_median_price_cpl - b.market_median_price_cpl), 4) mean_spread, round(stddev_samp(a.market_median_price_cpl - b.market_median_price_cpl), 4) std_spread,
    round(quantile_cont(a.market_median_price_cpl - b.market_median_price_cpl, 0.1), 4) p10, round(quantile_cont(a.market_median_price_cpl - b.market_median_price_cpl, 0.9), 4) p90 from med a join med b on a.market_date = b.market_date and b.fuel_type = 'U91' and a.fuel_type <> 'U91' group by 1, 2""")
def spread_study(spark, sf_dir):
    m = P.market_median(daily(spark, sf_dir))
    base = m.where("fuel_type = 'U91'").select("market_date", F.col("fuel_type").alias("other_fuel"), F.col("market_median_price_cpl").alias("_b"))
    s = m.where("fuel_type <> 'U91'").join(base, "market_date").withColumn("_s", F.col("market_median_price_cpl") - F.col("_b"))
    return round_doubles(s.groupBy("fuel_type", "other_fuel").agg(F.count("*").alias("days"), F.avg("_s").alias("mean_spread"), F.stddev("_s").alias("std_spread"), F.percentile("_s", 0.1).alias("p10"), F.percentile("_s", 0.9).alias("p90")))


@query("select station_id, fuel_type, market_date, round(daily_close_price_cpl - lag(daily_close_price_cpl) over (partition by station_id, fuel_type order by market_date), 4) change_cpl from daily qualify change_cpl is not null")
def own_changes(spark, sf_dir):
    c = F.col("daily_close_price_cpl") - F.lag("daily_close_price_cpl").over(series(P.SERIES, "market_date"))
    return round_doubles(daily(spark, sf_dir).select(*KEY, c.alias("change_cpl")).where("change_cpl is not null"))
