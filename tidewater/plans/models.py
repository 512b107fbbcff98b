"""Boosted trees for jumps and prices: leaf-wise, 31 leaves, on histograms, see boosting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.boosting import Boosted, BoostParams, fit, predicted

#: Inputs of the jump classifier, and of the forecasts at a market's grain; names of the feature tables' columns.
FEATURES = [
    "daily_close_price_cpl", "market_median_price_cpl", "local_competitor_median_price_cpl", "local_competitor_min_price_cpl", "local_competitor_max_price_cpl",
    "station_price_percentile", "station_vs_competitor_median_cpl", "rank_within_local_market", "competitor_count", "tgp_cpl", "indicative_margin_cpl", "margin_compression_cpl",
    "rolling_7d_min_price", "rolling_7d_max_price", "rolling_7d_mean_price", "rolling_7d_std_price", "rolling_14d_min_price", "rolling_14d_max_price", "rolling_14d_price_change_cpl",
    "days_since_local_minimum", "days_since_last_detected_jump", "price_position_within_14d_range", "tgp_7d_change_cpl", "day_of_week", "is_public_holiday",
]
MARKET_FEATURES = [
    "market_median_price_cpl", "market_daily_change_cpl", "rolling_7d_mean_price", "rolling_7d_std_price", "rolling_7d_min_price", "rolling_7d_max_price",
    "rolling_14d_mean_price", "rolling_14d_std_price", "rolling_14d_min_price", "rolling_14d_max_price", "days_since_last_jump", "tgp_7d_change_cpl", "day_of_week", "is_public_holiday",
]


def jump_classifier(rows: DataFrame, label: str = "jump_within_48h", features: list[str] = FEATURES, trees: int = 200) -> Boosted:
    """A classifier on balanced classes: each class weighs half."""
    return fit(rows, [*features, "fuel_type"], label, True, BoostParams(trees=trees))


def jump_probabilities(model: Boosted, rows: DataFrame) -> DataFrame:
    return predicted(model, rows, "jump_probability")


def price_regressor(rows: DataFrame, label: str, features: list[str], trees: int = 300) -> Boosted:
    return fit(rows, [*features, "fuel_type"], label, False, BoostParams(trees=trees, min_child=10))


def predicted_prices(model: Boosted, rows: DataFrame) -> DataFrame:
    return predicted(model, rows, "predicted_price")


def horizon_forecasts(frame: DataFrame, train_end, horizons: tuple[int, ...] = (1, 3, 7), features: list[str] = MARKET_FEATURES, trees: int = 300) -> DataFrame:
    """frame's rows after train_end with forecast_{h}d and forecast_{h}d_change_cpl: one regressor a horizon, fitted on the days up to train_end."""
    out = frame.where(F.col("market_date") > F.lit(train_end))
    for h in horizons:
        model = price_regressor(frame.where(F.col("market_date") <= F.lit(train_end)), f"target_price_h{h}", features, trees)
        out = predicted_prices(model, out).withColumnRenamed("predicted_price", f"forecast_{h}d")
        out = out.withColumn(f"forecast_{h}d_change_cpl", F.col(f"forecast_{h}d") - F.col("market_median_price_cpl"))
    return out
