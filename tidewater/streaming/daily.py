"""Daily prices from a stream of observations: an addition to the batch plans, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_prices(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """station_id, fuel_type, day, open, close, low, high and count of each finished day; observations later than late are dropped."""
    at = F.struct("observed_at", "price_cpl")
    days = observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 day"), "station_id", "fuel_type")
    out = days.agg(F.min(at)["price_cpl"].alias("daily_open_price_cpl"), F.max(at)["price_cpl"].alias("daily_close_price_cpl"), F.min("price_cpl").alias("daily_min_price_cpl"), F.max("price_cpl").alias("daily_max_price_cpl"), F.count("*").alias("daily_observation_count"))
    return out.select("station_id", "fuel_type", F.col("window.start").cast("date").alias("market_date"), *(c for c in out.columns if c.startswith("daily_")))


def write_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished days to Parquet, by day; all that is there is worked off, then the query ends."""
    return days.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("market_date").outputMode("append").trigger(availableNow=True).start()
