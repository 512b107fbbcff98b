"""Eligibility, rules, evaluation, forecasts and the pricing policy, as DataFrame plans."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.ordered import with_prefix_sums
from tidewater.operators.windows import last_rows, series, trend, with_rows_since, with_rows_unchanged
from tidewater.params import PolicyParams, SeriesParams, ThresholdParams

SERIES = ["station_id", "fuel_type"]


def series_stats(daily: DataFrame, params: SeriesParams = SeriesParams()) -> DataFrame:
    """Observations, span in days and extreme 14-row changes of every series."""
    w = series(SERIES, "market_date")
    moved = daily.withColumn("_c", F.abs(F.col("daily_close_price_cpl") - F.lag("daily_close_price_cpl", 14).over(w)))
    return moved.groupBy(*SERIES).agg(
        F.count("*").alias("total_observations"),
        (F.datediff(F.max("market_date"), F.min("market_date")) + 1).cast("long").alias("span_days"),
        F.count_if(F.col("_c") > params.extreme_change).alias("extreme_changes"),
    )


def eligibility(stats: DataFrame, params: SeriesParams = SeriesParams()) -> DataFrame:
    """Which series may be modelled; limits themselves pass."""
    rate = F.round(F.coalesce(F.try_divide("extreme_changes", "total_observations"), F.lit(1.0)), 6)
    short = F.when(F.col("total_observations") < params.min_observations, "insufficient_history")
    wild = F.when(rate > params.max_extreme_rate, "excessive_volatility")
    reason = F.concat_ws("+", short, wild)
    return stats.withColumns({"extreme_change_rate": rate, "is_eligible": reason == "", "exclusion_reason": F.nullif(reason, F.lit(""))})


def walk_forward_folds(start: date, end: date, min_train: int, test_days: int, n_folds: int) -> list[tuple[int, date, date, date, date]]:
    """(fold, train start, train end, test start, test end): training expands, tests follow each other, none passes end."""
    if min(min_train, test_days, n_folds) <= 0:
        raise ValueError("min_train, test_days and n_folds must be positive")
    out = []
    for k in range(n_folds):
        first = start + timedelta(days=min_train + k * test_days)
        last = first + timedelta(days=test_days - 1)
        if last > end:
            break
        out.append((k, start, first - timedelta(days=1), first, last))
    return out


def in_folds(rows: DataFrame, folds: list[tuple], day: str = "market_date") -> DataFrame:
    """rows in each fold's test range, with fold; folds is a small table, so this is one pass whatever their number."""
    spark = rows.sparkSession
    f = spark.createDataFrame(folds, "fold int, train_start date, train_end date, test_start date, test_end date")
    return rows.join(F.broadcast(f), F.col(day).between(F.col("test_start"), F.col("test_end")))


def calibration_slices(rows: DataFrame, folds: list[tuple], validation_days: int, day: str = "market_date") -> DataFrame:
    """rows in each fold with its slice: fit, then validation (the last days of training), then test. A row comes once for each fold that has it."""
    spark = rows.sparkSession
    table = [(k, a, b - timedelta(days=validation_days), b, c, d) for k, a, b, c, d in folds]
    f = spark.createDataFrame(table, "fold int, train_start date, fit_end date, train_end date, test_start date, test_end date")
    at = F.col(day)
    where = F.when(at.between(F.col("train_start"), F.col("fit_end")), "fit").when(at.between(F.date_add("fit_end", 1), F.col("train_end")), "validation").when(at.between(F.col("test_start"), F.col("test_end")), "test")
    return rows.join(F.broadcast(f), where.isNotNull()).withColumn("slice", where).drop("train_start", "fit_end", "train_end", "test_start", "test_end")


def training_set(inputs: DataFrame, eligibility: DataFrame, labels: DataFrame) -> DataFrame:
    """The inputs of eligible series beside the labels of their fuel and day; the only place where both meet."""
    good = eligibility.where("is_eligible").select(*SERIES)
    return inputs.join(good, SERIES, "left_semi").join(labels.select("fuel_type", "market_date", "jump_today", "jump_within_48h"), ["fuel_type", "market_date"])


def daily_scoring(inputs: DataFrame, eligibility: DataFrame, train_end: date, lookback_days: int = 60) -> DataFrame:
    """What is to be scored: eligible series on the last day that any of them has, with days_since_price_change in the look-back.

    No rows if that day isn't behind train_end: a model must not score what it has learned from.
    """
    good = inputs.join(eligibility.where("is_eligible").select(*SERIES), SERIES, "left_semi")
    last = good.agg(F.max("market_date").alias("score_date"))
    recent = good.join(F.broadcast(last), F.col("market_date") >= F.date_sub("score_date", lookback_days)).where(F.col("score_date") > F.lit(train_end))
    counted = with_rows_unchanged(recent, "daily_close_price_cpl", series(SERIES, "market_date"), "days_since_price_change")
    return counted.withColumn("days_since_price_change", F.col("days_since_price_change").cast("long")).where("market_date = score_date").drop("score_date")


def sensitivity(changes: DataFrame, thresholds: list[float]) -> DataFrame:
    """Jumps at each threshold by fuel: events, days, frequency, median size and least gap."""
    w = Window.partitionBy("fuel_type").orderBy("market_date")
    rows = changes.withColumn("_n", F.row_number().over(w)).withColumn("threshold", F.explode(F.lit([float(t) for t in thresholds])))
    hit = rows.withColumn("_hit", F.coalesce(F.col("market_daily_change_cpl") >= F.col("threshold"), F.lit(False)))
    gaps = hit.where("_hit").withColumn("_gap", F.col("_n") - F.lag("_n").over(Window.partitionBy("fuel_type", "threshold").orderBy("_n")))
    found = gaps.groupBy("fuel_type", "threshold").agg(F.count("*").alias("events"), F.percentile("market_daily_change_cpl", 0.5).alias("median_magnitude"), F.min("_gap").cast("long").alias("min_gap"))
    total = hit.groupBy("fuel_type", "threshold").agg(F.count("*").alias("market_days"))
    out = total.join(found, ["fuel_type", "threshold"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return out.withColumn("frequency", F.round(F.col("events") / F.col("market_days"), 4))


def jump_groups(labels: DataFrame) -> DataFrame:
    """Days numbered from the last jump on: the island of each jump and the place in it."""
    w = series(["fuel_type"], "market_date")
    islands = labels.withColumn("island", F.sum(F.col("jump_today").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("fuel_type", "island").orderBy("market_date")).cast("long") - 1
    return islands.withColumn("rows_in_island", place).select("fuel_type", "market_date", "jump_today", "island", "rows_in_island")


def baseline_rule(labels: DataFrame, params: SeriesParams = SeriesParams()) -> DataFrame:
    """Predict a jump once the median gap between the fuel's jumps has passed since the last one."""
    w = series(["fuel_type"], "market_date")
    numbered = labels.withColumn("_n", F.row_number().over(w))
    gaps = numbered.where("jump_today").withColumn("_gap", F.col("_n") - F.lag("_n").over(w))
    cycle = gaps.groupBy("fuel_type").agg(F.percentile("_gap", 0.5).alias("cycle"))
    rows = with_rows_since(labels, F.col("jump_today"), w, "days_since_jump").join(cycle, "fuel_type", "left")
    rows = rows.withColumn("cycle", F.coalesce("cycle", F.lit(params.default_cycle_days)))
    return rows.select("fuel_type", "market_date", F.col("days_since_jump").cast("long").alias("days_since_jump"), "cycle", F.coalesce(F.col("days_since_jump") >= F.col("cycle"), F.lit(False)).alias("predicted"))


def majority_vote(predictions: DataFrame) -> DataFrame:
    """A market day is predicted positive if at least half of its rows are."""
    return predictions.groupBy("fuel_type", "market_date").agg((F.avg(F.col("predicted").cast("int")) >= 0.5).alias("predicted"), F.max("jump_today").alias("jump_today"))


def warnings(days: DataFrame, max_lead: int = 2, by: tuple[str, ...] = ("fuel_type",)) -> DataFrame:
    """By fuel: warnings, those followed by a jump within max_lead rows, false alarms, mean lead, jumps and jumps warned of."""
    w = series(list(by), "market_date")
    leads = [F.when(F.lead("jump_today", k).over(w), k) for k in range(1, max_lead + 1)]
    rows = days.withColumn("_n", F.row_number().over(w)).withColumn("_lead", F.when(F.col("predicted"), F.coalesce(*leads)))
    return rows.groupBy(*by).agg(
        F.count_if("predicted").alias("warnings"),
        F.count("_lead").alias("matched_warnings"),
        F.count_if(F.col("predicted") & F.col("_lead").isNull()).alias("false_alarms"),
        F.avg("_lead").alias("avg_lead_days"),
        F.count_if("jump_today").alias("jumps"),
        F.count_distinct(F.col("_n") + F.col("_lead")).alias("jumps_warned"),
        F.count("*").alias("market_days"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold_sweep(scores: DataFrame, params: ThresholdParams = ThresholdParams()) -> DataFrame:
    """Measures of every threshold by fuel: precision, recall, F1 and false-positive rate of rows; warnings (alerts), false alarms per 30 market days
    and mean lead of market days by majority vote. scores: fuel_type, market_date, probability, actual, jump_today.

    Rows are counted once by fuel, day and threshold; everything else comes from that small table.
    """
    rows = scores.withColumn("threshold", F.explode(F.lit(list(params.grid)))).withColumn("_p", F.col("probability") >= F.col("threshold"))
    kinds = {"tp": F.col("_p") & F.col("actual"), "fp": F.col("_p") & ~F.col("actual"), "fn": ~F.col("_p") & F.col("actual"), "tn": ~F.col("_p") & ~F.col("actual")}
    days = rows.groupBy("fuel_type", "threshold", "market_date").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()), F.max("jump_today").alias("jump_today"))
    by = ["fuel_type", "threshold"]
    n = days.groupBy(*by).agg(*(F.sum(k).alias(k) for k in kinds))
    n = n.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "false_positive_rate": _ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    n = n.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    voted = days.withColumn("predicted", 2 * (F.col("tp") + F.col("fp")) >= F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    warned = warnings(voted, by=tuple(by))
    return n.join(warned.select(*by, F.col("warnings").alias("alerts"), (30.0 * F.col("false_alarms") / F.col("market_days")).alias("false_alarms_per_month"), "avg_lead_days"), by)


def threshold_choice(candidates: DataFrame, params: ThresholdParams = ThresholdParams()) -> DataFrame:
    """By fuel the threshold of the highest F1, the lowest of equals, among those with enough recall, few enough false alarms and enough lead; else the fallback."""
    lead = F.coalesce(F.col("avg_lead_days") >= params.min_lead_days, F.lit(False))
    good = (F.col("recall") >= params.min_recall) & (F.col("false_alarms_per_month") <= params.max_false_alarms) & lead
    best = F.max_by("threshold", F.when(good, F.struct("f1", -F.col("threshold"))))
    chosen = candidates.groupBy("fuel_type").agg(best.alias("chosen"), F.bool_or(good).alias("qualified"))
    return chosen.select("fuel_type", F.when(F.col("qualified"), F.col("chosen")).otherwise(params.fallback).alias("threshold"), (~F.col("qualified")).alias("is_fallback"))


def row_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By fuel: precision, recall, F1, average precision (null without a positive) and rates of positives, over single rows."""
    p, a = F.col("probability") >= threshold, F.col("actual")
    n = scores.groupBy("fuel_type").agg(F.count_if(p & a).alias("tp"), F.count_if(p).alias("alerts"), F.count_if(a).alias("positives"), F.count("*").alias("row_count"))
    n = n.withColumns({"precision": _ratio(F.col("tp"), F.col("alerts")), "recall": _ratio(F.col("tp"), F.col("positives"))})
    n = n.withColumns({"f1": _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "positive_rate_actual": F.col("positives") / F.col("row_count"), "positive_rate_predicted": F.col("alerts") / F.col("row_count")})
    return n.join(average_precision(scores), "fuel_type").drop("tp", "alerts", "positives")


def average_precision(scores: DataFrame, ranges: int | None = None) -> DataFrame:
    """By fuel, the step-wise sum of precision over gains in recall at each distinct score; null without a positive.

    Rows and hits above a score are prefix sums over ranges of scores, so a fuel's scores may be more than a task holds.
    """
    by = scores.groupBy("fuel_type", "probability").agg(F.count("*").alias("n"), F.count_if("actual").alias("hits"))
    by = with_prefix_sums(by, ["fuel_type"], [F.desc("probability")], {"_n": "n", "_hits": "hits"}, ranges)
    return by.groupBy("fuel_type").agg(F.try_divide(F.sum(F.col("hits") * F.col("_hits") / F.col("_n")), F.sum("hits")).alias("average_precision"))


def forecasts(changes: DataFrame, horizon: int, mean_rows: int = 7, trend_rows: int = 14) -> DataFrame:
    """Persistence, trailing mean and trend of the market series, beside what came horizon rows later."""
    w = series(["fuel_type"], "market_date")
    x = F.col("market_median_price_cpl")
    rows = changes.withColumn("_n", F.row_number().over(w).cast("double"))
    return rows.withColumns(
        {
            "persistence": x,
            "moving_average": F.avg(x).over(last_rows(w, mean_rows)),
            "trend": trend(x, F.col("_n"), w, trend_rows, horizon),
            "actual": F.lead(x, horizon).over(w),
        }
    ).drop("_n")


def market_series_context(cycle: DataFrame) -> DataFrame:
    """Weekday, holiday and mean wholesale change of a fuel's day, from the features of its series."""
    return cycle.groupBy("fuel_type", "market_date").agg(F.max("day_of_week").alias("day_of_week"), F.max(F.col("is_public_holiday").cast("int")).alias("is_public_holiday"), F.avg("tgp_7d_change_cpl").alias("tgp_7d_change_cpl"))


def forecast_frame(labels: DataFrame, context: DataFrame, windows: tuple[int, ...] = (7, 14), horizons: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """A market series' inputs for forecasting, trailing only, and its targets at each horizon, counted in market days.

    All over one partitioning by fuel. The standard deviation of a single day is 0.
    """
    w = series(["fuel_type"], "market_date")
    x = F.col("market_median_price_cpl")
    rows = labels.select("fuel_type", "market_date", "market_median_price_cpl", "market_daily_change_cpl", "jump_today").join(context, ["fuel_type", "market_date"], "left")
    rows = rows.withColumn("is_public_holiday", F.coalesce("is_public_holiday", F.lit(0)))
    rows = with_rows_since(rows, F.col("jump_today"), w, "days_since_last_jump").withColumn("days_since_last_jump", F.col("days_since_last_jump").cast("long"))
    new = {}
    for k in windows:
        over = last_rows(w, k)
        new |= {f"rolling_{k}d_mean_price": F.avg(x).over(over), f"rolling_{k}d_std_price": F.coalesce(F.stddev(x).over(over), F.lit(0.0)), f"rolling_{k}d_min_price": F.min(x).over(over), f"rolling_{k}d_max_price": F.max(x).over(over)}
    for h in horizons:
        new |= {f"target_price_h{h}": F.lead(x, h).over(w), f"target_jump_today_h{h}": F.lead("jump_today", h).over(w), f"target_daily_change_h{h}": F.lead("market_daily_change_cpl", h).over(w)}
    return rows.withColumns(new)


def forecast_metrics(forecast: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE (without zero actuals), WAPE and directional accuracy of each method. Rows without an actual or a forecast don't count."""
    rows = forecast.unpivot([*by, "market_median_price_cpl", "actual"], ["persistence", "moving_average", "trend"], "method", "predicted").where("actual is not null and predicted is not null")
    off = F.abs(F.col("actual") - F.col("predicted"))
    direction = F.signum(F.col("actual") - F.col("market_median_price_cpl")) == F.signum(F.col("predicted") - F.col("market_median_price_cpl"))
    return rows.groupBy(*by, "method").agg(
        F.count("*").alias("n"),
        F.avg(off).alias("mae"),
        F.sqrt(F.avg(off * off)).alias("rmse"),
        (100 * F.avg(F.try_divide(off, F.nullif(F.abs("actual"), F.lit(0.0))))).alias("mape"),
        (100 * F.try_divide(F.sum(off), F.sum(F.abs("actual")))).alias("wape"),
        F.avg(direction.cast("int")).alias("directional_accuracy"),
    )


def market_phase(jump: Column, change: Column) -> Column:
    return F.when(jump, "jump").when(change < 0, "decline").otherwise("other")


def staleness(daily: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    rows = with_rows_unchanged(daily, "daily_close_price_cpl", series(SERIES, "market_date"), "days_unchanged")
    return rows.withColumn("days_unchanged", F.col("days_unchanged").cast("long")).withColumn("is_stale", F.col("days_unchanged") >= params.stale_days)


def decided(rows: DataFrame, params: PolicyParams = PolicyParams(), floor: Column | None = None) -> DataFrame:
    """rows with the policy's decision. Needs fuel_type, price, probability, forecast, gap, tgp and margin; floor overrides the least margin.

    In order: no price, HOLD; expected jump and rising forecast while not above the market, LEAD; above the market or a falling
    forecast, FOLLOW down to the competitors' median or the forecast, not below the least margin, and HOLD where that bars any cut;
    else HOLD. Without a wholesale price a FOLLOW is unguarded, and its status says so.
    """
    price, gap, forecast, tgp = F.col("price"), F.col("gap"), F.col("forecast"), F.col("tgp")
    floor = F.lit(params.min_margin) if floor is None else floor
    yes = lambda c: F.coalesce(c, F.lit(False))
    limits = F.create_map(*(F.lit(x) for pair in params.thresholds for x in pair))
    auto = F.col("fuel_type").isin(*params.automated)
    rows = rows.withColumns({"_auto": auto, "jump_threshold": F.coalesce(limits[F.col("fuel_type")], F.lit(params.default_threshold)), "_above": yes(gap >= params.follow_min_overpriced), "_rise": yes(forecast >= params.lead_min_forecast_change), "_fall": yes(forecast <= -params.follow_forecast_decline)})
    rows = rows.withColumn("_jump", F.col("_auto") & yes(F.col("probability") >= F.col("jump_threshold")))
    branch = F.when(price.isNull(), "none").when(F.col("_jump") & F.col("_rise") & ~F.col("_above"), "lead").when(F.col("_above") | F.col("_fall"), "follow").otherwise("hold")
    rows = rows.withColumns({"_branch": branch, "_target": F.when(F.col("_above"), price - gap).otherwise(price + forecast)})
    rows = rows.withColumn("_capped", yes((F.col("_branch") == "follow") & (F.col("_target") - tgp < floor)))
    rows = rows.withColumn("_barred", F.col("_capped") & (tgp + floor >= price))
    lead, follow = F.col("_branch") == "lead", (F.col("_branch") == "follow") & ~F.col("_barred")
    action = F.when(lead, "LEAD").when(follow, "FOLLOW").otherwise("HOLD")
    cause = F.when(F.col("_above"), "priced_above_competitor_median").otherwise("forecast_decline")
    reason = F.when(F.col("_branch") == "none", "insufficient_data").when(lead, "jump_signal_and_rising_forecast").when(F.col("_barred"), "margin_guardrail_blocked_follow").when(follow, F.concat(cause, F.when(F.col("_capped"), "_margin_capped").otherwise(""))).otherwise("no_trigger")
    mode = F.when(F.col("_auto"), "automated").otherwise("watch_only")
    status = F.when(lead, "automated").when(follow & tgp.isNull(), "disabled_unsafe").otherwise(mode)
    new_price = F.when(F.col("_branch") == "none", None).when(lead, price + params.lead_step).when(follow, F.when(F.col("_capped"), tgp + floor).otherwise(F.col("_target"))).otherwise(price)
    out = rows.withColumns(
        {
            "policy_mode": mode, "action": action, "reason": reason, "recommendation_status": status, "guardrail_triggered": F.col("_capped"),
            "jump_signal_used": lead | (F.col("_branch") == "hold") & F.col("_jump"),
            "forecast_signal_used": F.when(F.col("_branch") == "follow", F.col("_fall")).when(F.col("_branch") == "hold", F.col("_rise") | F.col("_fall")).otherwise(lead),
            "hypothetical_price": new_price,
        }
    )
    held = F.col("action") == "HOLD"
    out = out.withColumn("hypothetical_margin", F.when(F.col("_branch") == "none", None).when(held, F.col("margin")).otherwise(F.col("hypothetical_price") - tgp))
    return out.drop("_auto", "_above", "_rise", "_fall", "_jump", "_branch", "_target", "_capped", "_barred")


def policy_summary(recommendations: DataFrame) -> DataFrame:
    """Counts and margins by fuel and over ALL of them, in one rollup. Margins are null, not 0, where no row has one."""
    r = recommendations
    is_ = lambda name, value: F.count_if(F.col(name) == value)
    out = r.rollup("fuel_type").agg(
        F.grouping("fuel_type").alias("_all"), F.min("policy_mode").alias("_mode"),
        is_("action", "HOLD").alias("hold_count"), is_("action", "FOLLOW").alias("follow_count"), is_("action", "LEAD").alias("lead_count"),
        F.count_if("guardrail_triggered").alias("guardrail_intervention_count"),
        F.count_if(F.col("is_stale") & (F.col("action") == "HOLD")).alias("stale_days_policy"), F.count_if("is_stale").alias("stale_days_baseline"),
        F.count_if("priced_above").alias("days_above"), F.count_if(F.col("priced_above") & (F.col("action") != "FOLLOW")).alias("days_above_unaddressed"),
        is_("recommendation_status", "automated").alias("automated_count"), is_("recommendation_status", "watch_only").alias("watch_only_count"), is_("recommendation_status", "disabled_unsafe").alias("disabled_unsafe_count"),
        F.avg("margin_difference").alias("avg_margin_difference"), F.sum("margin_difference").alias("total_margin_difference"),
        F.count_if("jump_signal_used").alias("jump_signal_count"), F.count_if("forecast_signal_used").alias("forecast_signal_count"),
        F.avg(F.when(F.col("action") == "LEAD", F.col("jump_within_48h").cast("int"))).alias("lead_hit_rate"), F.count("*").alias("row_count"),
    )
    named = {"fuel_type": F.when(F.col("_all") == 1, "ALL").otherwise(F.col("fuel_type")), "policy_mode": F.when(F.col("_all") == 1, "mixed").otherwise(F.col("_mode"))}
    return out.withColumns(named).drop("_all", "_mode")


def fuel_status(spark: SparkSession, summary: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Each fuel's standing and a note on it; fuels without a row in the backtest are disabled."""
    fuels = spark.createDataFrame([(f,) for f, _ in params.thresholds], "fuel_type string")
    s = fuels.join(summary.where("fuel_type <> 'ALL'"), "fuel_type", "left")
    auto = F.col("fuel_type").isin(*params.automated)
    unsafe = F.coalesce(F.col("disabled_unsafe_count"), F.lit(0)) > 0
    status = F.when(F.col("row_count").isNull(), "disabled").when(auto & ~unsafe, "automated").when(auto, "automated_unguarded").otherwise("watch_only")
    note = F.when(unsafe, F.concat_ws(" ", F.col("disabled_unsafe_count").cast("string"), F.lit("recommendations without a margin guardrail"))).otherwise("")
    return s.select("fuel_type", status.alias("status"), note.alias("note"), F.coalesce("row_count", F.lit(0)).alias("row_count"))
