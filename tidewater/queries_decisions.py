"""Queries on eligibility, evaluation, forecasts and the pricing policy."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.windows import series
from tidewater.params import PolicyParams, SeriesParams, ThresholdParams
from tidewater.plans import decisions as D
from tidewater.plans import features as P
from tidewater.queries_features import KEY, changes, daily, gold, round_doubles, shared_daily
from tidewater.queries_sql import rounded, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The events cover 30 days, so series and folds are shorter here than in production.
SHORT = SeriesParams(min_observations=8)
FOLDS = D.walk_forward_folds(date(2024, 1, 1), date(2024, 1, 30), 12, 4, 4)
HORIZON = 3
LOOSE = ThresholdParams(min_recall=0.3)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_(sql)
        return f

    return register


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.jump_labels(P.market_median(daily(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model's probabilities: a fixed function of station and day."""
    d = shared_daily(spark, sf_dir)
    return scored(d, P.jump_labels(P.market_median(d)))


def scored(daily: DataFrame, labels: DataFrame) -> DataFrame:
    p = ((F.col("station_id").cast("long") * 31 + F.dayofmonth("market_date") * 17) % 100).cast("double") / 100
    known = labels.select("fuel_type", "market_date", F.col("jump_within_48h").alias("actual"), "jump_today")
    return daily.select(*KEY, p.alias("probability")).join(known, ["fuel_type", "market_date"])


@query("""select station_id, fuel_type, count(*) total_observations, datediff('day', min(market_date), max(market_date)) + 1 span_days, count(*) filter (abs(c) > 100) extreme_changes
    from (select *, daily_close_price_cpl - lag(daily_close_price_cpl, 14) over (partition by station_id, fuel_type order by market_date) c from daily) x group by 1, 2""")
def series_stats(spark, sf_dir):
    return D.series_stats(daily(spark, sf_dir))


@query("""select station_id, fuel_type, total_observations, extreme_changes, round(extreme_changes::double / total_observations, 6) extreme_change_rate, total_observations >= 8 and extreme_changes::double / total_observations <= 0.1 is_eligible,
    nullif(concat_ws('+', case when total_observations < 8 then 'insufficient_history' end, case when extreme_changes::double / total_observations > 0.1 then 'excessive_volatility' end), '') exclusion_reason
    from (select station_id, fuel_type, count(*) total_observations, count(*) filter (abs(c) > 20) extreme_changes from (select *, daily_close_price_cpl - lag(daily_close_price_cpl, 14) over (partition by station_id, fuel_type order by market_date) c from daily) x group by 1, 2) y""")
def eligibility(spark, sf_dir):
    p = SeriesParams(min_observations=8, extreme_change=20.0)
    return D.eligibility(D.series_stats(daily(spark, sf_dir), p), p).drop("span_days")


@query("select f.fold, fuel_type, count(*) n, min(market_date) first_day, max(market_date) last_day from daily d join folds f on market_date between test_start and test_end group by 1, 2")
def walk_forward_folds(spark, sf_dir):
    return D.in_folds(daily(spark, sf_dir), FOLDS).groupBy("fold", "fuel_type").agg(F.count("*").alias("n"), F.min("market_date").alias("first_day"), F.max("market_date").alias("last_day"))


@query("""select fuel_type, threshold, count(*) market_days, coalesce(count(*) filter (hit), 0) events, round(coalesce(count(*) filter (hit), 0)::double / count(*), 4) frequency, round(quantile_cont(market_daily_change_cpl, 0.5) filter (hit), 4) median_magnitude, min(gap) min_gap
    from (select *, case when hit then n - lag(n) over (partition by fuel_type, threshold, hit order by n) end gap from (select *, coalesce(market_daily_change_cpl >= threshold, false) hit, row_number() over (partition by fuel_type, threshold order by market_date) n
    from changes, (values (3.0::double), (5.0), (7.0), (10.0), (15.0)) t(threshold)) a) b group by 1, 2""")
def jump_sensitivity(spark, sf_dir):
    return round_doubles(D.sensitivity(changes(spark, sf_dir), [3, 5, 7, 10, 15]))


@query("select fuel_type, market_date, jump_today, island, row_number() over (partition by fuel_type, island order by market_date) - 1 rows_in_island from (select *, cast(sum(jump_today::int) over (partition by fuel_type order by market_date) as bigint) island from labels) x")
def jump_groups(spark, sf_dir):
    return D.jump_groups(labels(spark, sf_dir))


@query("""select l.fuel_type, market_date, days_since_jump, coalesce(cycle, 14.0) cycle, coalesce(days_since_jump >= coalesce(cycle, 14.0), false) predicted
    from (select *, n - max(case when jump_today then n end) over (partition by fuel_type order by market_date) days_since_jump from (select *, row_number() over (partition by fuel_type order by market_date) n from labels) a) l
    left join (select fuel_type, quantile_cont(gap, 0.5)::double as cycle from (select fuel_type, n - lag(n) over (partition by fuel_type order by n) gap from (select *, row_number() over (partition by fuel_type order by market_date) n from labels) b where jump_today) c group by 1) g using (fuel_type)""")
def baseline_rule(spark, sf_dir):
    return D.baseline_rule(labels(spark, sf_dir))


VOTE = "select fuel_type, market_date, avg((probability >= 0.5)::int) >= 0.5 predicted, max(jump_today) jump_today from scores group by 1, 2"


@query(VOTE)
def majority_vote(spark, sf_dir):
    return D.majority_vote(scores(spark, sf_dir).withColumn("predicted", F.col("probability") >= 0.5))


@query(f"""select fuel_type, count(*) filter (predicted) warnings, count(lead_) matched_warnings, count(*) filter (predicted and lead_ is null) false_alarms, round(avg(lead_), 4) avg_lead_days, count(*) filter (jump_today) jumps, count(distinct n + lead_) jumps_warned, count(*) market_days
    from (select *, row_number() over w n, case when predicted then case when lead(jump_today) over w then 1 when lead(jump_today, 2) over w then 2 end end lead_ from ({VOTE}) v window w as (partition by fuel_type order by market_date)) x group by 1""")
def warning_eval(spark, sf_dir):
    return round_doubles(D.warnings(majority_vote(spark, sf_dir)))


SWEEP_DAYS = """select fuel_type, threshold, market_date, count(*) filter (p and actual) tp, count(*) filter (p and not actual) fp, count(*) filter (not p and actual) fn, count(*) filter (not p and not actual) tn, max(jump_today) jump_today
    from (select fuel_type, market_date, actual, jump_today, threshold, probability >= threshold p from scores, (select unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[]) threshold) g) a group by 1, 2, 3"""
SWEEP = f"""select n.*, w.alerts, w.false_alarms_per_month, w.avg_lead_days from (select fuel_type, threshold, tp, fp, fn, tn, coalesce(tp::double / nullif(tp + fp, 0), 0) as precision, coalesce(tp::double / nullif(tp + fn, 0), 0) recall, coalesce(fp::double / nullif(fp + tn, 0), 0) false_positive_rate,
    coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) f1 from (select fuel_type, threshold, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(tn)::bigint tn from ({SWEEP_DAYS}) d group by 1, 2) b) n
    join (select fuel_type, threshold, count(*) filter (predicted) alerts, 30.0::double * count(*) filter (predicted and lead_ is null) / count(*) false_alarms_per_month, avg(lead_) avg_lead_days
    from (select *, case when predicted then case when lead(jump_today) over w then 1 when lead(jump_today, 2) over w then 2 end end lead_ from (select *, 2 * (tp + fp) >= tp + fp + fn + tn predicted from ({SWEEP_DAYS}) d) v
    window w as (partition by fuel_type, threshold order by market_date)) y group by 1, 2) w using (fuel_type, threshold)"""
MEASURED = ["precision", "recall", "false_positive_rate", "f1", "false_alarms_per_month", "avg_lead_days"]


@query(f"select fuel_type, threshold, tp, fp, fn, tn, alerts, {rounded(MEASURED)} from ({SWEEP}) s")
def threshold_sweep(spark, sf_dir):
    return round_doubles(D.threshold_sweep(scores(spark, sf_dir)))


QUALIFIES = "recall >= 0.3 and false_alarms_per_month <= 6 and coalesce(avg_lead_days >= 1, false)"


@query(f"select fuel_type, coalesce(arg_min(threshold, (-f1, threshold)) filter ({QUALIFIES}), 0.5) threshold, count(*) filter ({QUALIFIES}) = 0 is_fallback from (select fuel_type, threshold, recall, false_alarms_per_month, avg_lead_days, round(f1, 9) f1 from ({SWEEP}) s) t group by 1")
def threshold_choice(spark, sf_dir):
    return D.threshold_choice(D.threshold_sweep(scores(spark, sf_dir)).withColumn("f1", F.round("f1", 9)))


@query("""select fuel_type, round(sum(hits * ch::double / cn) / nullif(sum(hits), 0), 6) average_precision from (select *, sum(n) over w cn, sum(hits) over w ch from (select fuel_type, probability, count(*) n, count(*) filter (actual) hits from scores group by 1, 2) a
    window w as (partition by fuel_type order by probability desc)) b group by 1""")
def average_precision(spark, sf_dir):
    return round_doubles(D.average_precision(scores(spark, sf_dir)), 6)


FORECAST = """select fuel_type, market_date, market_median_price_cpl, market_daily_change_cpl, market_median_price_cpl persistence, avg(market_median_price_cpl) over (w rows between 6 preceding and current row) moving_average,
    case when n >= 2 then regr_intercept(market_median_price_cpl, n) over (w rows between 13 preceding and current row) + regr_slope(market_median_price_cpl, n) over (w rows between 13 preceding and current row) * (n + 3) end trend, lead(market_median_price_cpl, 3) over w actual
    from (select *, row_number() over (partition by fuel_type order by market_date)::double n from changes) x window w as (partition by fuel_type order by market_date)"""
METHODS = ["persistence", "moving_average", "trend", "actual"]


@query(f"select fuel_type, market_date, {rounded(METHODS)} from ({FORECAST}) f")
def forecast_baselines(spark, sf_dir):
    return round_doubles(D.forecasts(changes(spark, sf_dir), HORIZON).select("fuel_type", "market_date", *METHODS))


MEASURES = """count(*) n, round(avg(off), 4) mae, round(sqrt(avg(off * off)), 4) rmse, round(100 * avg(off / nullif(abs(actual), 0)), 4) mape, round(100 * sum(off) / nullif(sum(abs(actual)), 0), 4) wape,
    round(avg((sign(actual - market_median_price_cpl) = sign(predicted - market_median_price_cpl))::int), 4) directional_accuracy"""
LONG = f"select *, abs(actual - predicted) off from (select fuel_type, market_median_price_cpl, market_daily_change_cpl, actual, unnest(['persistence', 'moving_average', 'trend']) method, unnest([persistence, moving_average, round(trend, 9)]) predicted from ({FORECAST}) f) l where actual is not null and predicted is not null"


@query(f"select fuel_type, method, {MEASURES} from ({LONG}) x group by 1, 2")
def forecast_metrics(spark, sf_dir):
    return round_doubles(D.forecast_metrics(D.forecasts(changes(spark, sf_dir), HORIZON).withColumn("trend", F.round("trend", 9)), ["fuel_type"]))


@query(f"select case when market_daily_change_cpl >= 7 then 'jump' when market_daily_change_cpl < 0 then 'decline' else 'other' end phase, method, {MEASURES} from ({LONG}) x group by 1, 2")
def forecast_phase(spark, sf_dir):
    f = D.forecasts(changes(spark, sf_dir), HORIZON).withColumn("trend", F.round("trend", 9))
    change = F.col("market_daily_change_cpl")
    return round_doubles(D.forecast_metrics(f.withColumn("phase", D.market_phase(F.coalesce(change >= 7, F.lit(False)), change)), ["phase"]))


STALE = """select *, n - max(case when not same then n end) over (partition by station_id, fuel_type order by market_date) days_unchanged from (select *, row_number() over w n, coalesce(price = lag(price) over w, false) same
    from (select station_id, fuel_type, market_date, round(daily_close_price_cpl / 40) * 40 price from daily) d window w as (partition by station_id, fuel_type order by market_date)) x"""


@query(f"select station_id, fuel_type, market_date, days_unchanged, days_unchanged >= 2 is_stale from ({STALE}) s")
def price_staleness(spark, sf_dir):
    d = daily(spark, sf_dir).select(*KEY, (F.round(F.col("daily_close_price_cpl") / 40) * 40).alias("daily_close_price_cpl"))
    return D.staleness(d, PolicyParams(stale_days=2)).select(*KEY, "days_unchanged", "is_stale")


def _inputs(t: dict[str, DataFrame]) -> DataFrame:
    """Prices, margins and gaps of every day, with stand-ins for the model's outputs; the feature tables meet as they lie."""
    daily = t["station_daily_market"]
    m = daily.select(*KEY, F.col("daily_close_price_cpl").alias("price"), F.col("station_vs_competitor_median_cpl").alias("gap"))
    g = t["indicative_margin"].select(*KEY, F.col("tgp_cpl").alias("tgp"), F.col("indicative_margin_cpl").alias("margin"))
    labels = P.jump_labels(daily)
    s = scored(daily, labels).select(*KEY, "probability", F.col("actual").alias("jump_within_48h"))
    c = labels.select("fuel_type", "market_date", (3 * F.col("market_daily_change_cpl")).alias("forecast"))
    return m.join(g, KEY, "left").join(s, KEY, "left").join(c, ["fuel_type", "market_date"], "left")


def policy_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return gold(spark, sf_dir, "station_daily_market", "indicative_margin")


def policy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(policy_tables(spark, sf_dir))


def recommendations(spark: SparkSession, sf_dir: str, params: PolicyParams = PolicyParams()) -> DataFrame:
    t = policy_tables(spark, sf_dir)
    stale = D.staleness(t["station_daily_market"], params).select(*KEY, "is_stale")
    above = F.coalesce(F.col("gap") >= params.follow_min_overpriced, F.lit(False))
    return D.decided(_inputs(t), params).join(stale, KEY).withColumns({"priced_above": above, "margin_difference": F.col("hypothetical_margin") - F.col("margin")})


INPUTS = """select d.station_id, d.fuel_type, d.market_date, d.daily_close_price_cpl price, d.station_vs_competitor_median_cpl gap, m.tgp_cpl tgp, m.indicative_margin_cpl margin, s.probability, s.actual jump_within_48h, 3 * c.market_daily_change_cpl forecast
    from market d left join margin m using (station_id, fuel_type, market_date) left join scores s using (station_id, fuel_type, market_date) left join changes c using (fuel_type, market_date)"""


def decided_sql(floor: str = "2.0::double", source: str = INPUTS) -> str:
    a = f"""select *, {floor} floor_, fuel_type in ('E10', 'P98', 'DL', 'PDL') auto_, case fuel_type when 'U91' then 0.5 when 'E10' then 0.4 when 'P95' then 0.5 when 'P98' then 0.35 when 'DL' then 0.35 when 'PDL' then 0.65 else 0.5 end::double jump_threshold,
        coalesce(gap >= 4, false) above_, coalesce(forecast >= 5, false) rise_, coalesce(forecast <= -5, false) fall_ from ({source}) i"""
    b = f"""select *, auto_ and coalesce(probability >= jump_threshold, false) jump_, case when auto_ and coalesce(probability >= jump_threshold, false) and rise_ and not above_ then 'lead' when above_ or fall_ then 'follow' else 'hold' end branch,
        case when above_ then price - gap else price + forecast end target from ({a}) a"""
    c = f"select *, coalesce(branch = 'follow' and target - tgp < floor_, false) capped from ({b}) b"
    d = f"select *, capped and tgp + floor_ >= price barred from ({c}) c"
    return f"""select *, case when auto_ then 'automated' else 'watch_only' end policy_mode, case when branch = 'lead' then 'LEAD' when branch = 'follow' and not barred then 'FOLLOW' else 'HOLD' end as action,
        case when branch = 'lead' then 'jump_signal_and_rising_forecast' when barred then 'margin_guardrail_blocked_follow' when branch = 'follow' then (case when above_ then 'priced_above_competitor_median' else 'forecast_decline' end) || (case when capped then '_margin_capped' else '' end) else 'no_trigger' end reason,
        case when branch = 'lead' then 'automated' when branch = 'follow' and not barred and tgp is null then 'disabled_unsafe' when auto_ then 'automated' else 'watch_only' end recommendation_status, capped guardrail_triggered,
        branch = 'lead' or (branch = 'hold' and jump_) jump_signal_used, case branch when 'follow' then fall_ when 'hold' then rise_ or fall_ else true end forecast_signal_used,
        case when branch = 'lead' then price + 2 when branch = 'follow' and not barred then case when capped then tgp + floor_ else target end else price end hypothetical_price,
        case when branch = 'hold' or barred then margin else hypothetical_price - tgp end hypothetical_margin from ({d}) d"""


SHOWN = ["price", "jump_threshold", "hypothetical_price", "hypothetical_margin"]
FLAGS = ["policy_mode", "action", "reason", "recommendation_status", "guardrail_triggered", "jump_signal_used", "forecast_signal_used"]


@query(f"select station_id, fuel_type, market_date, {', '.join(FLAGS)}, {rounded(SHOWN)} from ({decided_sql()}) p")
def policy_decision(spark, sf_dir):
    return round_doubles(D.decided(policy_inputs(spark, sf_dir)).select(*KEY, *FLAGS, *SHOWN))


RECOMMENDED = f"""select p.*, coalesce(gap >= 4, false) priced_above, hypothetical_margin - margin margin_difference, st.days_unchanged >= 7 is_stale from ({decided_sql()}) p join ({STALE.replace('round(daily_close_price_cpl / 40) * 40', 'daily_close_price_cpl')}) st using (station_id, fuel_type, market_date)"""
SUMMARY = f"""select coalesce(fuel_type, 'ALL') fuel_type, case when fuel_type is null then 'mixed' else min(policy_mode) end policy_mode, count(*) filter (action = 'HOLD') hold_count, count(*) filter (action = 'FOLLOW') follow_count, count(*) filter (action = 'LEAD') lead_count,
    count(*) filter (guardrail_triggered) guardrail_intervention_count, count(*) filter (is_stale and action = 'HOLD') stale_days_policy, count(*) filter (is_stale) stale_days_baseline, count(*) filter (priced_above) days_above, count(*) filter (priced_above and action <> 'FOLLOW') days_above_unaddressed,
    count(*) filter (recommendation_status = 'automated') automated_count, count(*) filter (recommendation_status = 'watch_only') watch_only_count, count(*) filter (recommendation_status = 'disabled_unsafe') disabled_unsafe_count,
    round(avg(margin_difference), 4) avg_margin_difference, round(sum(margin_difference), 2) total_margin_difference, count(*) filter (jump_signal_used) jump_signal_count, count(*) filter (forecast_signal_used) forecast_signal_count,
    round(avg(jump_within_48h::int) filter (action = 'LEAD'), 4) lead_hit_rate, count(*) row_count from ({RECOMMENDED}) r group by rollup (fuel_type)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.policy_summary(recommendations(spark, sf_dir))


@query(SUMMARY)
def policy_summary(spark, sf_dir):
    return round_doubles(summary(spark, sf_dir).withColumn("total_margin_difference", F.round("total_margin_difference", 2)))


@query(f"""select f fuel_type, case when row_count is null then 'disabled' when f in ('E10', 'P98', 'DL', 'PDL') and coalesce(disabled_unsafe_count, 0) = 0 then 'automated' when f in ('E10', 'P98', 'DL', 'PDL') then 'automated_unguarded' else 'watch_only' end status,
    case when coalesce(disabled_unsafe_count, 0) > 0 then disabled_unsafe_count || ' recommendations without a margin guardrail' else '' end note, coalesce(row_count, 0) row_count
    from (select unnest(['U91', 'E10', 'P95', 'P98', 'DL', 'PDL']) f) x left join ({SUMMARY}) s on s.fuel_type = f""")
def fuel_status(spark, sf_dir):
    return D.fuel_status(spark, summary(spark, sf_dir))


@query(f"""select floor_, fuel_type, count(*) filter (action = 'FOLLOW') follow_count, count(*) filter (guardrail_triggered) interventions, round(avg(hypothetical_margin), 4) avg_margin from ({decided_sql('g_floor', f'select * from ({INPUTS}) i0, (select unnest([0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]::double[]) g_floor) g')}) p group by 1, 2""")
def guardrail_sweep(spark, sf_dir):
    rows = policy_inputs(spark, sf_dir).withColumn("floor_", F.explode(F.lit([k / 2 for k in range(11)])))
    d = D.decided(rows, floor=F.col("floor_"))
    return round_doubles(d.groupBy("floor_", "fuel_type").agg(F.count_if(F.col("action") == "FOLLOW").alias("follow_count"), F.count_if("guardrail_triggered").alias("interventions"), F.avg("hypothetical_margin").alias("avg_margin")))


WARNED = """case recommendation_status when 'disabled_unsafe' then 'No wholesale margin guards ' || fuel_type || ': for information only.' when 'watch_only' then fuel_type || ' is watched only: advisory.' end warning_message"""


@query(f"select p.station_id, s.brand, s.postcode, fuel_type, market_date, action, recommendation_status, round(hypothetical_price, 4) hypothetical_price, {WARNED} from ({decided_sql()}) p left join stations s using (station_id)")
def dashboard(spark, sf_dir):
    from tidewater.sources.events import stations

    status = F.col("recommendation_status")
    note = F.when(status == "disabled_unsafe", F.concat(F.lit("No wholesale margin guards "), "fuel_type", F.lit(": for information only."))).when(status == "watch_only", F.concat("fuel_type", F.lit(" is watched only: advisory.")))
    d = D.decided(policy_inputs(spark, sf_dir)).join(stations(spark, sf_dir).select("station_id", "brand", "postcode"), "station_id", "left")
    return round_doubles(d.select("station_id", "brand", "postcode", "fuel_type", "market_date", "action", "recommendation_status", "hypothetical_price", note.alias("warning_message")))


@query("select fuel_type, station_id, max(market_date) market_date from (select *, count(*) over (partition by station_id, fuel_type) n from daily where market_date > (select max(market_date) from daily) - 20) x where n >= 3 group by 1, 2")
def latest_scorable(spark, sf_dir):
    """The last day of each series with enough rows in the look-back, the daily score's input."""
    d = daily(spark, sf_dir)
    last = d.agg(F.max("market_date").alias("_last"))
    recent = d.join(F.broadcast(last), F.col("market_date") > F.date_sub("_last", 20))
    return recent.groupBy("fuel_type", "station_id").agg(F.count("*").alias("n"), F.max("market_date").alias("market_date")).where("n >= 3").drop("n")


@query(f"select fuel_type, arg_min(method, (round(wape, 6), method)) best_method, round(min(wape), 4) wape from (select fuel_type, method, 100 * sum(off) / nullif(sum(abs(actual)), 0) wape from ({LONG}) x group by 1, 2) y group by 1")
def best_forecast(spark, sf_dir):
    """The method of the least WAPE by fuel; of equals the first by name."""
    m = D.forecast_metrics(D.forecasts(changes(spark, sf_dir), HORIZON).withColumn("trend", F.round("trend", 9)), ["fuel_type"])
    return round_doubles(m.groupBy("fuel_type").agg(F.min_by("method", F.struct(F.round("wape", 6), F.col("method"))).alias("best_method"), F.min("wape").alias("wape")))


@query("select fuel_type, market_date, count(*) n, count(*) filter (p) positives, count(*) filter (p and actual) hits, round(coalesce((count(*) filter (p and actual))::double / nullif(count(*) filter (p), 0), 0), 6) as precision from (select *, probability >= 0.5 p from scores) s group by grouping sets ((fuel_type), (fuel_type, market_date))")
def day_metrics(spark, sf_dir):
    """Row precision by fuel and by fuel and day, in one pass over grouping sets."""
    s = scores(spark, sf_dir).withColumn("p", F.col("probability") >= 0.5)
    hits = F.count_if(F.col("p") & F.col("actual"))
    g = s.groupingSets([["fuel_type"], ["fuel_type", "market_date"]], "fuel_type", "market_date")
    return g.agg(F.count("*").alias("n"), F.count_if("p").alias("positives"), hits.alias("hits"), F.round(F.coalesce(F.try_divide(hits, F.count_if("p")), F.lit(0.0)), 6).alias("precision"))
