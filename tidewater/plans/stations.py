"""Matching of two station lists by address, the station master, and what of it is in doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import address_key
from tidewater.operators.quality import BOUNDS, issue_rows


def keyed(stations: DataFrame) -> DataFrame:
    """stations (code, address, postcode, more) with match_key."""
    return stations.withColumn("match_key", address_key(F.col("address"), F.col("postcode")))


def crosswalk(official: DataFrame, bulk: DataFrame) -> DataFrame:
    """Each official station with bulk_code and match: matched (its key is one station's on both sides), ambiguous or reference_only."""
    a, b = keyed(official), keyed(bulk).withColumnRenamed("code", "bulk_code")
    count = lambda df, c, n: df.groupBy("match_key").agg(F.count_distinct(c).alias(n), F.min(c).alias(f"_{n}"))
    both = a.join(count(a, "code", "officials").drop("_officials"), "match_key").join(count(b, "bulk_code", "bulks"), "match_key", "left")
    kind = F.when(F.col("bulks").isNull(), "reference_only").when((F.col("officials") == 1) & (F.col("bulks") == 1), "matched").otherwise("ambiguous")
    return both.select(*official.columns, "match_key", kind.alias("match"), F.when(kind == "matched", F.col("_bulks")).alias("bulk_code"))


def station_master(walk: DataFrame) -> DataFrame:
    """The stations with coordinates: matched ones, and official ones that the bulk list lacks. Ambiguous ones are left out, not guessed."""
    method = F.when(F.col("match") == "matched", "exact_address_postcode").otherwise("reference_only_no_bulk_match")
    return walk.where("match <> 'ambiguous'").select(F.sha2("code", 256).alias("station_id"), "code", "bulk_code", "address", "postcode", F.upper("brand").alias("brand_normalized"), "latitude", "longitude", method.alias("match_method"), F.lit(1.0).alias("match_confidence"))


def matched_one_to_one(walk: DataFrame) -> DataFrame:
    return walk.where("match = 'matched'").select("match_key", F.col("code").alias("official"), F.col("bulk_code").alias("bulk"))


def station_issues(walk: DataFrame, bulk: DataFrame) -> DataFrame:
    """Ambiguous official stations (warnings), and bulk stations whose key no official one has (errors)."""
    ambiguous = walk.where("match = 'ambiguous'").select("code", "address")
    alone = keyed(bulk).join(walk.select("match_key"), "match_key", "left_anti").select("code", "address")
    return issue_rows(ambiguous, "code", "station_match_ambiguous", "warning", "address,postcode", "address", "raw_stations", "stations").unionByName(
        issue_rows(alone, "code", "station_unmatched_no_coordinates", "error", "address,postcode", "address", "raw_stations", "stations")
    )


def unmatched_prices(prices: DataFrame, master: DataFrame) -> DataFrame:
    """Issues of prices (record, address, postcode, observed_at, price), good in themselves, whose address is no station's of the master."""
    good = prices.where(F.col("observed_at").try_cast("timestamp").isNotNull() & F.col("price").try_cast("double").between(*BOUNDS))
    alone = keyed(good).join(keyed(master).select("match_key"), "match_key", "left_anti")
    return issue_rows(alone, "record", "price_station_unmatched", "error", "address,postcode", "address", "raw_prices", "prices")


def from_prices(prices: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """A station for each combination of by in the prices, with the first and the last day that it was seen."""
    return prices.groupBy(*by).agg(F.min(day).alias("first_seen_date"), F.max(day).alias("last_seen_date"))
