"""The feature tables as a whole: built once from shared inputs, written by day, measured and checked."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.plans import features as P
from tidewater.sources import versions
from tidewater.sources.raw import write_partitions

KEYS = {"station_daily_market": P.KEY, "competitor_positioning": [*P.KEY, "competitor_station_id"], "indicative_margin": P.KEY, "market_cycle_features": P.KEY, "daily_pricing_inputs": P.KEY, "price_jump_labels": ["fuel_type", "market_date"]}


def gold_tables(daily: DataFrame, stations: DataFrame, wholesale: DataFrame, holidays: DataFrame) -> dict[str, DataFrame]:
    """The six tables as plans over daily prices, which are read many times: a written table, or one that the caller keeps."""
    market = P.station_market(daily, stations)
    margin = P.indicative_margin(daily, wholesale)
    cycle = P.market_cycle_features(daily.join(P.market_median(daily), ["fuel_type", "market_date"]), margin, holidays)
    return {
        "station_daily_market": market,
        "competitor_positioning": P.competitor_positioning(daily, P.competitor_spots(stations), stations),
        "indicative_margin": margin,
        "market_cycle_features": cycle,
        "daily_pricing_inputs": P.daily_pricing_inputs(market, margin, cycle),
        "price_jump_labels": P.jump_labels(P.market_median(daily)),
    }


#: Tables of series, bucketed alike; the others have a row a market and day.
SERIES_TABLES = ("station_daily_market", "competitor_positioning", "indicative_margin", "market_cycle_features", "daily_pricing_inputs")


def commit_gold(spark: SparkSession, prices: DataFrame, stations: DataFrame, wholesale: DataFrame, holidays: DataFrame, database: str, root: str, buckets: int | None = None, only: tuple[str, ...] = tuple(KEYS)) -> dict[str, DataFrame]:
    """Rebuild the tables of database (those named in only), each committed as a whole under root and built from those committed before it.

    Series tables are bucketed by station and fuel (as many buckets as the session has shuffle partitions, if not said), so windows over a
    series and joins on series and day read them as they lie; the plans over them stand in a session of their own, see versions.colocating().
    Returned frames belong to that session.
    """
    here = versions.colocating(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = versions.Buckets(n, tuple(P.SERIES), tuple(P.KEY))
    here.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    out = {}

    def put(name: str, make: Callable[[], DataFrame]) -> None:
        if name in only:
            rows = schemas.evolved(make(), name)
            versions.commit(rows, f"{database}.{name}", root, kept if name in SERIES_TABLES else None)
            out[name] = versions.table(here, f"{database}.{name}")

    def base(name: str, rows: DataFrame, buckets: versions.Buckets | None = None) -> DataFrame:
        versions.commit(rows, f"{database}.{name}", root, buckets)
        return versions.table(here, f"{database}.{name}")

    daily = base("daily_prices", P.daily_ohlc(prices), kept)
    near = None
    if {"station_daily_market", "competitor_positioning"} & {*only}:
        found = P.competitor_spots(stations)
        near = P.Near(base("competitor_spots", found.members), base("competitor_edges", found.edges))
    medians = base("market_medians", P.market_median(daily))
    put("station_daily_market", lambda: P.station_market(daily, stations, colocated=n, medians=medians, near=near))
    put("competitor_positioning", lambda: P.competitor_positioning(daily, near, stations))
    put("indicative_margin", lambda: P.indicative_margin(daily, wholesale, asof=base("market_wholesale", P.wholesale_asof(medians, wholesale))))
    put("market_cycle_features", lambda: P.market_cycle_features(out["station_daily_market"], out["indicative_margin"], holidays, days=base("market_days", P.market_days(medians, holidays))))
    put("daily_pricing_inputs", lambda: P.daily_pricing_inputs(out["station_daily_market"], out["indicative_margin"], out["market_cycle_features"]))
    put("price_jump_labels", lambda: P.jump_labels(medians))
    return out


def write_gold(spark: SparkSession, prices: DataFrame, stations: DataFrame, wholesale: DataFrame, holidays: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write the tables under root, each from the written ones before it, and return them as read. Days that prices has are overwritten, others stay."""
    out = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        write_partitions(schemas.evolved(df, name), f"{root}/{name}", ["market_date"])
        out[name] = spark.read.schema(schemas.schema(name)).parquet(f"{root}/{name}")
        return out[name]

    market = put("station_daily_market", P.station_daily_market(prices, stations))
    median = market.select("fuel_type", "market_date", "market_median_price_cpl").distinct()
    put("competitor_positioning", P.competitor_positioning(market, P.competitor_spots(stations), stations))
    margin = put("indicative_margin", P.indicative_margin(market, wholesale))
    cycle = put("market_cycle_features", P.market_cycle_features(market, margin, holidays))
    put("price_jump_labels", P.jump_labels(median))
    put("daily_pricing_inputs", P.daily_pricing_inputs(market, margin, cycle))
    return out


def metrics(tables: dict[str, DataFrame], rivals: DataFrame | None = None) -> DataFrame:
    """(metric, value) over all tables: one aggregate a table, unpivoted. rivals: rivals_count() instead of the table of competitors, which has a row a pair."""
    t, share = tables, lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    odd = (F.col("indicative_margin_cpl") < -50) | (F.col("indicative_margin_cpl") > 100)
    parts = [x.agg(F.count("*").alias(f"{name}_row_count")) for name, x in t.items() if name not in ("station_daily_market", "indicative_margin", "market_cycle_features")]
    parts += [
        t["station_daily_market"].agg(F.count("*").alias("station_daily_market_row_count"), F.count_distinct("station_id").alias("distinct_stations"), F.count_distinct("fuel_type").alias("distinct_fuel_types"), share(F.col("competitor_count") > 0).alias("pct_rows_with_competitor_coverage")),
        t["indicative_margin"].agg(F.count("*").alias("indicative_margin_row_count"), share(F.col("tgp_cpl").isNotNull()).alias("pct_rows_with_valid_tgp"), share(odd).alias("pct_implausible_margin"), F.count_if(odd).alias("implausible_margin_row_count")),
        t["market_cycle_features"].agg(F.count("*").alias("market_cycle_features_row_count"), F.count_if(F.abs("rolling_14d_price_change_cpl") > 100).alias("extreme_14d_price_changes")),
        t["station_daily_market"].groupBy(*P.SERIES).count().agg(F.count_if(F.col("count") < 14).alias("series_under_14_days")),
    ]
    parts += [rivals.select(F.col("value").alias("competitor_positioning_row_count"))] if rivals is not None else []
    long = [p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns)))) for p in parts]
    jumps = t["price_jump_labels"].groupBy("fuel_type").agg(F.count_if("jump_today").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [*long, jumps.select(F.concat(F.lit("jump_days_"), "fuel_type").alias("metric"), "value")])


def leakage_checks(tables: dict[str, DataFrame], repeated: DataFrame | None = None) -> DataFrame:
    """repeated: repeated_rivals() instead of the table of competitors. (check, value): keys that occur more than once in each table, rows on an earlier day's wholesale price, inputs that labels can be joined to."""
    parts = [tables[n].groupBy(*k).count().agg(F.count_if(F.col("count") > 1).alias("value")).select(F.lit(f"{n}_duplicate_keys").alias("check"), "value") for n, k in KEYS.items() if n in tables]
    parts += [repeated.select(F.lit("competitor_positioning_duplicate_keys").alias("check"), "value")] if repeated is not None else []
    prior = tables["indicative_margin"].agg(F.count_if(F.col("tgp_match_type") == "latest_prior_date").alias("value")).select(F.lit("margin_rows_on_prior_date").alias("check"), "value")
    labelled = tables["daily_pricing_inputs"].join(tables["price_jump_labels"], ["fuel_type", "market_date"], "left_semi").agg(F.count("*").alias("value"))
    return reduce(DataFrame.unionByName, [*parts, prior, labelled.select(F.lit("inputs_joinable_to_labels").alias("check"), "value")])


def prerequisites(tables: dict[str, DataFrame], least: int = 1) -> DataFrame:
    """(name, n, ok) of each table that must not be empty."""
    from tidewater.operators.quality import counts

    return counts(tables).withColumn("ok", F.col("n") >= least)
