"""The market's clean tables, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUEL_OF_EVENT = {"view": "U91", "click": "DL", "purchase": "E10", "signup": "P95"}


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, fuel_type, observed_at, observed_date, price_cpl."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "value")
    fuel = F.lit("P98")
    for event, name in FUEL_OF_EVENT.items():
        fuel = F.when(F.col("event_type") == event, name).otherwise(fuel)
    return e.select(F.col("user_id").cast("string").alias("station_id"), fuel.alias("fuel_type"), F.col("ts").alias("observed_at"), F.to_date("ts").alias("observed_date"), (100 + F.col("value") * 0.5).alias("price_cpl"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, latitude, longitude, brand, address, postcode."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    place = lambda start, factor: F.lit(start) + ((F.col("user_id") * factor) % 1000).cast("double") / 1000 * 0.3
    brand = F.element_at(F.array(*map(F.lit, ("Aster", "Birch", "Cedar", "Dogwood"))), (F.col("user_id") % 4 + 1).cast("int"))
    address = F.concat((F.col("user_id") % 90 + 1).cast("string"), F.lit(" High St., "), F.when(F.col("user_id") % 3 == 0, "Bay  View").otherwise("Hill"), F.lit(" NSW "), (2000 + F.col("user_id") % 50).cast("string"))
    return u.select(F.col("user_id").cast("string").alias("station_id"), place(-33.9, 7919).alias("latitude"), place(150.9, 104729).alias("longitude"), brand.alias("brand"), address.alias("address"), (2000 + F.col("user_id") % 50).cast("string").alias("postcode"))


def wholesale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fuel_type, tgp_date, tgp_cpl: two fuels, with gaps of days."""
    p = prices(spark, sf_dir).where(F.col("fuel_type").isin("U91", "DL") & (F.dayofmonth("observed_date") % 3 != 0))
    return p.groupBy("fuel_type", F.col("observed_date").alias("tgp_date")).agg((F.avg("price_cpl") - 15).alias("tgp_cpl"))


def holidays(spark: SparkSession) -> DataFrame:
    """holiday_date, holiday_name."""
    rows = [("2024-01-01", "New Year's Day"), ("2024-01-26", "Australia Day")]
    return spark.createDataFrame(rows, "d string, holiday_name string").select(F.to_date("d").alias("holiday_date"), "holiday_name")
