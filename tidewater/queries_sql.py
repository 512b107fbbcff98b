"""Common table expressions of the SQL equivalents, written in DuckDB's dialect on the events table."""

from __future__ import annotations

import re

CTES = {
    "prices": """select cast(user_id as varchar) station_id, case event_type when 'view' then 'U91' when 'click' then 'DL' when 'purchase' then 'E10' when 'signup' then 'P95' else 'P98' end fuel_type,
        ts observed_at, cast(ts as date) observed_date, 100 + value * cast(0.5 as double) price_cpl from events""",
    "stations": """select cast(user_id as varchar) station_id, cast(-33.9 as double) + cast((user_id*7919)%1000 as double)/1000*cast(0.3 as double) latitude,
        cast(150.9 as double) + cast((user_id*104729)%1000 as double)/1000*cast(0.3 as double) longitude,
        case user_id % 4 when 0 then 'Aster' when 1 then 'Birch' when 2 then 'Cedar' else 'Dogwood' end brand,
        cast(user_id % 90 + 1 as varchar) || ' High St., ' || case when user_id % 3 = 0 then 'Bay  View' else 'Hill' end || ' NSW ' || cast(2000 + user_id % 50 as varchar) address,
        cast(2000 + user_id % 50 as varchar) postcode from (select distinct user_id from events) u""",
    "tgp": "select fuel_type, observed_date tgp_date, avg(price_cpl) - 15 tgp_cpl from prices where fuel_type in ('U91','DL') and day(observed_date) % 3 <> 0 group by all",
    "hol": "select cast(d as date) holiday_date, n holiday_name from (values ('2024-01-01','New Year''s Day'), ('2024-01-26','Australia Day')) h(d, n)",
    "daily": """select station_id, fuel_type, observed_date market_date, first(price_cpl order by observed_at, price_cpl) daily_open_price_cpl, last(price_cpl order by observed_at, price_cpl) daily_close_price_cpl,
        min(price_cpl) daily_min_price_cpl, max(price_cpl) daily_max_price_cpl, count(*) daily_observation_count, max(observed_at) last_observed_at from prices group by 1, 2, 3""",
    "med": "select fuel_type, market_date, quantile_disc(daily_close_price_cpl, 0.5) market_median_price_cpl from daily group by 1, 2",
    "pairs": """select a.station_id, b.station_id competitor_station_id, 6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(a.latitude))*cos(radians(b.latitude))*cos(radians(b.longitude)-radians(a.longitude)) + sin(radians(a.latitude))*sin(radians(b.latitude))))) distance_km
        from stations a join stations b on a.station_id < b.station_id and abs(a.latitude-b.latitude) <= 0.06 and abs(a.longitude-b.longitude) <= 0.07 where distance_km <= 5""",
    "edges": "select station_id, competitor_station_id, distance_km from pairs union all select competitor_station_id, station_id, distance_km from pairs",
    "rivals": """select d.station_id, d.fuel_type, d.market_date, d.daily_close_price_cpl own_price, e.competitor_station_id, e.distance_km, c.daily_close_price_cpl competitor_price
        from daily d join edges e using (station_id) join daily c on c.station_id = e.competitor_station_id and c.fuel_type = d.fuel_type and c.market_date = d.market_date""",
    "cstats": """select station_id, fuel_type, market_date, count(competitor_price) competitor_count, min(competitor_price) local_competitor_min_price_cpl, max(competitor_price) local_competitor_max_price_cpl,
        quantile_disc(competitor_price, 0.5) local_competitor_median_price_cpl, avg(competitor_price) local_competitor_mean_price_cpl,
        1 + count(*) filter (competitor_price < own_price) rank_within_local_market, (count(*) filter (competitor_price < own_price))::double / count(*) station_price_percentile from rivals group by 1, 2, 3""",
    "market": """select d.*, m.market_median_price_cpl, coalesce(c.competitor_count, 0) competitor_count, c.local_competitor_min_price_cpl, c.local_competitor_max_price_cpl, c.local_competitor_median_price_cpl, c.local_competitor_mean_price_cpl,
        c.rank_within_local_market, c.station_price_percentile, d.daily_close_price_cpl - m.market_median_price_cpl price_vs_market_median_cpl, d.daily_close_price_cpl - c.local_competitor_median_price_cpl station_vs_competitor_median_cpl
        from daily d join med m using (fuel_type, market_date) left join cstats c using (station_id, fuel_type, market_date)""",
    "asofs": """select d.fuel_type, d.market_date, t.tgp_date matched_on, t.tgp_cpl, case when t.tgp_date = d.market_date then 'exact_same_day' when t.tgp_date is not null then 'latest_prior_date' else 'unmatched' end tgp_match_type
        from (select distinct fuel_type, market_date from daily) d asof left join tgp t on t.fuel_type = d.fuel_type and t.tgp_date <= d.market_date""",
    "margin0": """select d.station_id, d.fuel_type, d.market_date, d.daily_close_price_cpl retail_price_cpl, a.tgp_cpl, a.tgp_match_type, d.daily_close_price_cpl - a.tgp_cpl indicative_margin_cpl,
        row_number() over (partition by d.station_id, d.fuel_type order by d.market_date) rn from daily d join asofs a using (fuel_type, market_date)""",
    "share": """select a.station_id, a.fuel_type, a.market_date, case when a.indicative_margin_cpl is not null and count(b.indicative_margin_cpl) > 1 then (count(*) filter (b.indicative_margin_cpl <= a.indicative_margin_cpl) - 1)::double / (count(b.indicative_margin_cpl) - 1) end margin_percentile_30d
        from margin0 a join margin0 b on a.station_id = b.station_id and a.fuel_type = b.fuel_type and b.rn between a.rn - 29 and a.rn group by a.station_id, a.fuel_type, a.market_date, a.indicative_margin_cpl""",
    "margin": """select m.station_id, m.fuel_type, m.market_date, retail_price_cpl, tgp_cpl, tgp_match_type, indicative_margin_cpl, case when tgp_match_type = 'exact_same_day' then indicative_margin_cpl end price_tgp_spread_cpl,
        indicative_margin_cpl - avg(indicative_margin_cpl) over (partition by m.station_id, m.fuel_type order by m.market_date rows between 6 preceding and current row) margin_vs_7d_avg_cpl, s.margin_percentile_30d from margin0 m join share s using (station_id, fuel_type, market_date)""",
    "changes": "select fuel_type, market_date, market_median_price_cpl, market_median_price_cpl - lag(market_median_price_cpl) over (partition by fuel_type order by market_date) market_daily_change_cpl from med",
    "rolled": """select d.station_id, d.fuel_type, d.market_date, d.daily_close_price_cpl, c.market_median_price_cpl, c.market_daily_change_cpl, m.tgp_cpl, m.indicative_margin_cpl, h.holiday_date is not null is_public_holiday,
        min(d.daily_close_price_cpl) over w7 rolling_7d_min_price, max(d.daily_close_price_cpl) over w7 rolling_7d_max_price, avg(d.daily_close_price_cpl) over w7 rolling_7d_mean_price, stddev_samp(d.daily_close_price_cpl) over w7 rolling_7d_std_price,
        min(d.daily_close_price_cpl) over w14 rolling_14d_min_price, max(d.daily_close_price_cpl) over w14 rolling_14d_max_price, d.daily_close_price_cpl - lag(d.daily_close_price_cpl, 14) over w rolling_14d_price_change_cpl,
        d.daily_close_price_cpl - lag(d.daily_close_price_cpl) over w own_daily_change_cpl, m.tgp_cpl - lag(m.tgp_cpl, 7) over w tgp_7d_change_cpl, avg(m.indicative_margin_cpl) over w7 - m.indicative_margin_cpl margin_compression_cpl
        from daily d join changes c using (fuel_type, market_date) left join margin0 m using (station_id, fuel_type, market_date) left join hol h on h.holiday_date = d.market_date
        window w as (partition by d.station_id, d.fuel_type order by d.market_date), w7 as (partition by d.station_id, d.fuel_type order by d.market_date rows between 6 preceding and current row), w14 as (partition by d.station_id, d.fuel_type order by d.market_date rows between 13 preceding and current row)""",
    "cycle": """select station_id, fuel_type, market_date, rolling_7d_min_price, rolling_7d_max_price, rolling_7d_mean_price, rolling_7d_std_price, rolling_14d_min_price, rolling_14d_max_price, rolling_14d_price_change_cpl,
        datediff('day', max(case when daily_close_price_cpl = rolling_14d_min_price then market_date end) over w, market_date) days_since_local_minimum,
        datediff('day', max(case when own_daily_change_cpl >= 7 then market_date end) over w, market_date) days_since_last_detected_jump,
        case when rolling_14d_max_price > rolling_14d_min_price then (daily_close_price_cpl - rolling_14d_min_price) / (rolling_14d_max_price - rolling_14d_min_price) end price_position_within_14d_range,
        market_median_price_cpl, market_daily_change_cpl, tgp_7d_change_cpl, margin_compression_cpl, dayofweek(market_date) + 1 day_of_week, is_public_holiday
        from rolled window w as (partition by station_id, fuel_type order by market_date rows between unbounded preceding and current row)""",
    "labels": """select *, lead(jump_today) over w jump_within_24h, coalesce(lead(jump_today) over w, false) or coalesce(lead(jump_today, 2) over w, false) jump_within_48h
        from (select *, coalesce(market_daily_change_cpl >= 7, false) jump_today from changes) f window w as (partition by fuel_type order by market_date)""",
    "scores": """select d.station_id, d.fuel_type, d.market_date, ((cast(d.station_id as bigint) * 31 + day(d.market_date) * 17) % 100)::double / 100 probability, l.jump_within_48h actual, l.jump_today
        from daily d join labels l using (fuel_type, market_date)""",
    "folds": "select fold::int fold, date '2024-01-01' + (12 + fold * 4)::int test_start, date '2024-01-01' + (15 + fold * 4)::int test_end from (select unnest(generate_series(0, 3)) fold)",
}


def with_(select: str) -> str:
    """select behind the common table expressions that it needs, in their order."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                add(CTES[name])

    add(select)
    return f"with {', '.join(f'{k} as ({v})' for k, v in CTES.items() if k in needed)} {select}" if needed else select


def rounded(names: list[str], places: int = 4) -> str:
    """Engines round halves differently: means of a few prices take 8 places, which none of them halves."""
    return ", ".join(f"round({n}, {places}) as {n}" for n in names)
