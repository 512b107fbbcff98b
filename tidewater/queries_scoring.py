"""Queries on training sets, model inputs and scores."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.params import SeriesParams
from tidewater.plans import decisions as D
from tidewater.plans import features as P
from tidewater.plans import models as M
from tidewater.queries_decisions import FOLDS, labels, scores
from tidewater.queries_features import KEY, cycle, daily, inputs, round_doubles, shared_daily
from tidewater.queries_sql import rounded, with_
from tidewater.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The events cover 30 days: shorter series than in production, and trees of fewer rounds.
SERIES = SeriesParams(min_observations=8, extreme_change=20.0)
TRAIN_END, TREES = date(2024, 1, 24), 10


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_(sql)
        return f

    return register


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.eligibility(D.series_stats(daily(spark, sf_dir), SERIES), SERIES)


ELIGIBLE = """select station_id, fuel_type from (select *, daily_close_price_cpl - lag(daily_close_price_cpl, 14) over (partition by station_id, fuel_type order by market_date) c from daily) x group by 1, 2
    having count(*) >= 8 and count(*) filter (abs(c) > 20)::double / count(*) <= 0.1"""


@query(f"select station_id, fuel_type, market_date, {rounded(['daily_close_price_cpl', 'tgp_cpl', 'indicative_margin_cpl', 'rolling_7d_mean_price'], 8)}, competitor_count, jump_today, jump_within_48h from market m join ({ELIGIBLE}) e using (station_id, fuel_type) join labels l using (fuel_type, market_date) left join margin i using (station_id, fuel_type, market_date) left join (select station_id, fuel_type, market_date, rolling_7d_mean_price from cycle) c using (station_id, fuel_type, market_date)")
def training_set(spark, sf_dir):
    """Inputs of eligible series beside their labels."""
    t = D.training_set(inputs(spark, sf_dir), eligible(spark, sf_dir), labels(spark, sf_dir))
    return round_doubles(t.select(*KEY, "daily_close_price_cpl", "tgp_cpl", "indicative_margin_cpl", "rolling_7d_mean_price", "competitor_count", "jump_today", "jump_within_48h"), 8)


@query(f"""select station_id, fuel_type, market_date, days_since_price_change from (select *, n - max(case when not same then n end) over (partition by station_id, fuel_type order by market_date) days_since_price_change from (select *, row_number() over w n, coalesce(price = lag(price) over w, false) same
    from (select station_id, fuel_type, market_date, round(daily_close_price_cpl / 40) * 40 price, max(market_date) over () score_date from daily join ({ELIGIBLE}) e using (station_id, fuel_type)) d where market_date >= score_date - 60 and score_date > date '2024-01-24' window w as (partition by station_id, fuel_type order by market_date)) x) y
    where market_date = (select max(market_date) from daily join ({ELIGIBLE}) e using (station_id, fuel_type))""")
def daily_scoring(spark, sf_dir):
    """The rows to score: eligible series on their common last day, behind the end of training."""
    d = shared_daily(spark, sf_dir).select(*KEY, (F.round(F.col("daily_close_price_cpl") / 40) * 40).alias("daily_close_price_cpl"))
    return D.daily_scoring(d, eligible(spark, sf_dir), TRAIN_END).select(*KEY, "days_since_price_change")


@query("""select fold, fuel_type, slice, count(*) n, min(market_date) first_day, max(market_date) last_day from (select d.*, f.fold, case when market_date < date '2024-01-01' + (8 + f.fold * 4)::int then 'fit' when market_date < test_start then 'validation' when market_date <= test_end then 'test' end slice from daily d cross join folds f) x
    where slice is not null group by 1, 2, 3""")
def calibration_slices(spark, sf_dir):
    """What each fold fits on, calibrates on and tests on: the last four days of training are for calibration."""
    s = D.calibration_slices(daily(spark, sf_dir), FOLDS, 4)
    return s.groupBy("fold", "fuel_type", "slice").agg(F.count("*").alias("n"), F.min("market_date").alias("first_day"), F.max("market_date").alias("last_day"))


ROLLED = [f"rolling_{k}d_{m}_price" for k in (7, 14) for m in ("mean", "std", "min", "max")]
TARGETS = [f"target_{t}_h{h}" for h in (1, 3, 7) for t in ("price", "daily_change")]
_x = "market_median_price_cpl"


def _windows(k: int) -> str:
    w = f"over (partition by fuel_type order by market_date rows between {k - 1} preceding and current row)"
    return f"avg({_x}) {w} rolling_{k}d_mean_price, coalesce(stddev_samp({_x}) {w}, 0) rolling_{k}d_std_price, min({_x}) {w} rolling_{k}d_min_price, max({_x}) {w} rolling_{k}d_max_price"


def _ahead(h: int) -> str:
    w = "over (partition by fuel_type order by market_date)"
    return f"lead({_x}, {h}) {w} target_price_h{h}, lead(jump_today, {h}) {w} target_jump_today_h{h}, lead(market_daily_change_cpl, {h}) {w} target_daily_change_h{h}"


FRAME = f"""select *, n - max(case when jump_today then n end) over (partition by fuel_type order by market_date) days_since_last_jump, {_windows(7)}, {_windows(14)}, {_ahead(1)}, {_ahead(3)}, {_ahead(7)}
    from (select l.*, c.day_of_week, coalesce(c.is_public_holiday, 0) is_public_holiday, c.tgp_7d_change_cpl, row_number() over (partition by fuel_type order by market_date) n from labels l
    left join (select fuel_type, market_date, max(day_of_week) day_of_week, max(is_public_holiday::int) is_public_holiday, avg(tgp_7d_change_cpl) tgp_7d_change_cpl from cycle group by 1, 2) c using (fuel_type, market_date)) x"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.forecast_frame(labels(spark, sf_dir), D.market_series_context(cycle(spark, sf_dir)))


@query(f"select fuel_type, market_date, day_of_week, is_public_holiday, days_since_last_jump, target_jump_today_h1, target_jump_today_h3, target_jump_today_h7, {rounded(['market_median_price_cpl', 'market_daily_change_cpl', 'tgp_7d_change_cpl'] + ROLLED + TARGETS, 8)} from ({FRAME}) f")
def forecast_features(spark, sf_dir):
    """A market series' inputs and its targets 1, 3 and 7 market days on."""
    names = ["fuel_type", "market_date", "day_of_week", "is_public_holiday", "days_since_last_jump", "target_jump_today_h1", "target_jump_today_h3", "target_jump_today_h7"]
    return round_doubles(frame(spark, sf_dir).select(*names, "market_median_price_cpl", "market_daily_change_cpl", "tgp_7d_change_cpl", *ROLLED, *TARGETS), 8)


@query("""select fuel_type, market_date, day_of_week, is_public_holiday, round(market_median_price_cpl, 8) market_median_price_cpl, round(tgp_7d_change_cpl, 8) tgp_7d_change_cpl from labels l
    left join (select fuel_type, market_date, max(day_of_week) day_of_week, max(is_public_holiday::int) is_public_holiday, avg(tgp_7d_change_cpl) tgp_7d_change_cpl from cycle group by 1, 2) c using (fuel_type, market_date)""")
def series_context(spark, sf_dir):
    """The market series beside its weekday, holiday and wholesale context."""
    c = D.market_series_context(cycle(spark, sf_dir))
    out = labels(spark, sf_dir).join(c, ["fuel_type", "market_date"], "left")
    return round_doubles(out.select("fuel_type", "market_date", "day_of_week", "is_public_holiday", "market_median_price_cpl", "tgp_7d_change_cpl"), 8)


@query("""select fuel_type, row_count, round(coalesce(tp::double / nullif(alerts, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(positives, 0), 0), 6) recall, round(coalesce(2.0 * tp / nullif(alerts + positives, 0), 0), 6) f1, round(positives::double / row_count, 6) positive_rate_actual, round(alerts::double / row_count, 6) positive_rate_predicted,
    round(ap, 6) average_precision from (select fuel_type, count(*) filter (probability >= 0.5 and actual) tp, count(*) filter (probability >= 0.5) alerts, count(*) filter (actual) positives, count(*) row_count from scores group by 1) n
    join (select fuel_type, sum(hits * ch::double / cn) / nullif(sum(hits), 0) ap from (select *, sum(n) over w cn, sum(hits) over w ch from (select fuel_type, probability, count(*) n, count(*) filter (actual) hits from scores group by 1, 2) a window w as (partition by fuel_type order by probability desc)) b group by 1) p using (fuel_type)""")
def row_metrics(spark, sf_dir):
    return round_doubles(D.row_metrics(scores(spark, sf_dir)), 6)


@query(None)
def jump_model_scores(spark, sf_dir):
    """Boosted trees on the days up to TRAIN_END, probabilities of the days behind it. Trees are no SQL; tested on held-out rows."""
    t = D.training_set(inputs(spark, sf_dir), eligible(spark, sf_dir), labels(spark, sf_dir))
    t = written(t, "training")
    model = M.jump_classifier(t.where(F.col("market_date") <= F.lit(TRAIN_END)), trees=TREES)
    return M.jump_probabilities(model, t.where(F.col("market_date") > F.lit(TRAIN_END))).select(*KEY, "jump_within_48h", "jump_probability")


@query(None)
def forecast_model_scores(spark, sf_dir):
    """Forecasts 1, 3 and 7 market days on, one regressor a horizon. Trees are no SQL; tested against the last value."""
    f = written(frame(spark, sf_dir), "frame")
    out = M.horizon_forecasts(f, date(2024, 1, 20), trees=TREES)
    return out.select("fuel_type", "market_date", "market_median_price_cpl", *(f"forecast_{h}d" for h in (1, 3, 7)), *(f"forecast_{h}d_change_cpl" for h in (1, 3, 7)))
