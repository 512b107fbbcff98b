"""Queries on committed tables, streamed files, stored sketches and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators import quality as Q
from tidewater.operators import sketches as S
from tidewater.operators import upsert as U
from tidewater.plans import decisions as D
from tidewater.queries_decisions import WARNED, decided_sql, policy_inputs
from tidewater.queries_features import KEY, daily, round_doubles
from tidewater.queries_quality import RAW, raw
from tidewater.queries_sql import with_
from tidewater.sources import events as E
from tidewater.sources import raw as R
from tidewater.sources import versions
from tidewater.sources.shared import new_path, own_database
from tidewater.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_(sql)
        return f

    return register


def database(spark: SparkSession) -> str:
    name = own_database(spark)
    spark.sql(f"CREATE DATABASE {name}")
    return name


@query("select station_id, fuel_type, market_date, round(daily_close_price_cpl + case when day(market_date) >= 10 then 1 else 0 end, 4) daily_close_price_cpl, case when day(market_date) >= 10 then daily_observation_count end daily_observation_count from daily where day(market_date) <= 20 or day(market_date) >= 10")
def committed_upsert(spark, sf_dir):
    """Two versions of a bucketed table: the first 20 days, then an upsert of the days from the 10th on, which also brings a new column."""
    name, root = f"{database(spark)}.closes", new_path(spark, "closes")
    d = daily(spark, sf_dir).select(*KEY, "daily_close_price_cpl", "daily_observation_count")
    kept = versions.Buckets(int(spark.conf.get("spark.sql.shuffle.partitions")), tuple(KEY[:2]), tuple(KEY))
    now = versions.commit(d.where(F.dayofmonth("market_date") <= 20).drop("daily_observation_count"), name, root, kept)
    later = d.where(F.dayofmonth("market_date") >= 10).withColumn("daily_close_price_cpl", F.col("daily_close_price_cpl") + 1)
    return round_doubles(versions.commit(U.upsert(now.withColumn("daily_observation_count", F.lit(None).cast("long")), later, KEY), name, root, kept))


@query("select event_id::varchar as record, event_type fuel, round(value, 2) price, strftime(ts, '%Y-%m-%d %H:%M:%S') seen_at from events where event_id % 10 <> 3")
def streamed_files(spark, sf_dir):
    """Events as price files, some without a price, loaded as a stream into a committed table."""
    at, db = new_path(spark, "files"), database(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.round("value", 2).cast("string"))
    made = {"ServiceStationName": F.concat(F.lit("Station, "), F.col("user_id")), "Address": F.col("event_id").cast("string"), "FuelCode": F.col("event_type"), "PriceUpdatedDate": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "Price": price}
    e.select(*(made.get(c, F.lit("x")).alias(c) for c in R.PRICE_COLUMNS)).repartition("Address").write.option("header", True).csv(at)
    ingest.load_files(spark, at, new_path(spark, "loads"), f"{db}.prices", f"{db}.loads", new_path(spark, "loaded")).awaitTermination()
    p = versions.table(spark, f"{db}.prices")
    return p.select(F.col("Address").alias("record"), F.col("FuelCode").alias("fuel"), F.col("Price").alias("price"), F.col("PriceUpdatedDate").alias("seen_at"))


@query("""select a.fuel_type, a.market_date, count(*) n, round(quantile_disc(b.daily_close_price_cpl, 0.5), 6) median_7d, round(quantile_disc(b.daily_close_price_cpl, 0.9), 6) p90_7d from (select distinct fuel_type, market_date from daily) a
    join daily b on b.fuel_type = a.fuel_type and b.market_date between a.market_date - 6 and a.market_date group by 1, 2""")
def trailing_quantiles(spark, sf_dir):
    """Quantiles of the last seven days' closing prices from one stored sketch a fuel and day; exact up to 4096 prices, within 0.13 % of the rank beyond."""
    db, k = database(spark), 4096
    stored = versions.commit(S.sketched(daily(spark, sf_dir), ["fuel_type", "market_date"], "daily_close_price_cpl", k), f"{db}.sketches", new_path(spark, "sketches"))
    t = S.trailing(stored, ["fuel_type"], "market_date", 7, k)
    return round_doubles(t.select("fuel_type", "market_date", "n", S.quantile("sketch", 0.5).alias("median_7d"), S.quantile("sketch", 0.9).alias("p90_7d")), 6)


@query(f"select p.station_id, s.brand, s.postcode, fuel_type, market_date, action, recommendation_status, round(hypothetical_price, 4) hypothetical_price, {WARNED} from ({decided_sql()}) p left join stations s using (station_id)")
def dashboard_view(spark, sf_dir):
    """The dashboard by the name of its view, over catalog tables of recommendations and stations."""
    db = own_database(spark)
    schemas.create_all(spark, db)
    schemas.create_views(spark, db)
    for name, rows in (("recommendations", D.decided(policy_inputs(spark, sf_dir))), ("stations", E.stations(spark, sf_dir))):
        schemas.evolved(rows, name).write.insertInto(f"{db}.{name}")
        spark.catalog.refreshTable(f"{db}.{name}")  # recommendations are written by a session of their own
    return round_doubles(spark.table(f"{db}.pricing_dashboard"))


@query(f"select event_id from (select event_id, row_number() over (partition by user_id, coalesce(fuel, ''), day order by event_id desc) k from ({RAW}) r) x where k = 1")
def deduplicated_rows(spark, sf_dir):
    """What the configured rule on combinations leaves: the latest row of each."""
    rule = [{"rule": "unique_combination", "columns": ["user_id", "fuel", "day"], "action": "deduplicate_keep_latest"}]
    return Q.deduplicated(raw(spark, sf_dir), rule, [F.desc("event_id")]).select("event_id")
