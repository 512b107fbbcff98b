from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions import geo, text
from tidewater.operators import quality, upsert
from tidewater.operators.joins import asof_join, grid_pairs
from tidewater.operators.windows import series, with_rows_since, with_rows_unchanged
from tidewater.params import PolicyParams, SeriesParams, ThresholdParams
from tidewater.plans import decisions as D
from tidewater.plans import features as P
from tidewater.sources import raw

POLICY = "fuel_type string, price double, probability double, forecast double, gap double, tgp double, margin double"
BASE = {"fuel_type": "E10", "price": 180.0, "probability": 0.1, "forecast": 0.0, "gap": 0.0, "tgp": 165.0, "margin": 15.0}
CASES = [
    ({}, ("HOLD", "no_trigger", "automated", 180.0)),
    ({"price": None}, ("HOLD", "insufficient_data", "automated", None)),
    ({"probability": 0.6, "forecast": 6.0}, ("LEAD", "jump_signal_and_rising_forecast", "automated", 182.0)),
    ({"probability": 0.6, "forecast": 6.0, "tgp": None}, ("LEAD", "jump_signal_and_rising_forecast", "automated", 182.0)),
    ({"fuel_type": "U91", "probability": 0.9, "forecast": 6.0}, ("HOLD", "no_trigger", "watch_only", 180.0)),
    ({"probability": 0.6, "forecast": 6.0, "gap": 5.0}, ("FOLLOW", "priced_above_competitor_median", "automated", 175.0)),
    ({"gap": 6.0}, ("FOLLOW", "priced_above_competitor_median", "automated", 174.0)),
    ({"gap": 6.0, "tgp": None}, ("FOLLOW", "priced_above_competitor_median", "disabled_unsafe", 174.0)),
    ({"fuel_type": "U91", "gap": 6.0, "tgp": None}, ("FOLLOW", "priced_above_competitor_median", "disabled_unsafe", 174.0)),
    ({"forecast": -6.0}, ("FOLLOW", "forecast_decline", "automated", 174.0)),
    ({"gap": 20.0}, ("FOLLOW", "priced_above_competitor_median_margin_capped", "automated", 166.0)),
    ({"price": 165.5, "gap": 20.0}, ("HOLD", "margin_guardrail_blocked_follow", "automated", 165.5)),
    ({"fuel_type": "U91", "gap": 6.0}, ("FOLLOW", "priced_above_competitor_median", "watch_only", 174.0)),
]


def test_policy(spark):
    rows = spark.createDataFrame([({**BASE, **c}) for c, _ in CASES], POLICY).withColumn("i", F.monotonically_increasing_id())
    got = D.decided(rows, PolicyParams(min_margin=1.0)).orderBy("i").collect()
    assert [(r.action, r.reason, r.recommendation_status, r.hypothetical_price) for r in got] == [w for _, w in CASES]
    assert got[2].hypothetical_margin == 17.0 and got[11].guardrail_triggered


def one(spark, sql, *columns):
    return spark.sql(sql).select(*columns).first()


def test_text(spark):
    addresses = ["307-313 Ocean Beach Road, UMINA BEACH NSW 2257", "94 Sturt Hwy BALRANALD NSW 2715", "garbage", None]
    got = spark.createDataFrame([(a,) for a in addresses], "a string").select(text.address_parts(F.col("a")).alias("p")).select("p.*").collect()
    assert tuple(got[0]) == ("307-313 Ocean Beach Road", "UMINA BEACH", "2257") and got[1].postcode == "2715" and tuple(got[2]) == tuple(got[3]) == (None,) * 3
    r = one(spark, "select 'e10' a, 'DL' b, 'x' c, cast(null as string) d", *(text.fuel_name(F.col(c)) for c in "abcd"))
    assert tuple(r) == ("E10", "DIESEL", "X", "UNKNOWN")
    r = one(spark, "select 'Metro Alfa' a, 'alfa' b, '' c", text.names_agree(F.col("a"), F.col("b")), text.names_agree(F.col("a"), F.col("c")), text.address_key(F.col("a"), F.col("c")))
    assert tuple(r) == (True, False, "METRO ALFA|")
    r = one(spark, "select map('user', 'u', 'api_key', 'x') m", text.masked(F.col("m")))
    assert r[0] == {"user": "u", "api_key": "***"}
    assert one(spark, "select '1Anzac Day' a", text.clean_holiday(F.col("a")))[0] == "Anzac Day"


def test_geo(spark):
    r = one(spark, "select 1", geo.haversine_km(*map(F.lit, (-33.87, 151.21, -37.81, 144.96))), geo.haversine_km(*map(F.lit, (1.0, 2.0, 1.0, 2.0))), geo.in_box(F.lit(-40.0), F.lit(150.0)), geo.valid_url(F.lit("ftp://x")), geo.price_check(F.lit(50.0))["reason"])
    assert 700 < r[0] < 730 and r[1] == 0 and not r[2] and not r[3] and r[4] == "below minimum"


def test_grid_pairs_find_all(spark):
    points = [(str(i), -33.9 + (i * 7919 % 1000) / 3000, 150.9 + (i * 104729 % 1000) / 3000) for i in range(150)]
    df = spark.createDataFrame(points, "k string, latitude double, longitude double")
    got = {(r.k, r.other) for r in grid_pairs(df, "k", 5.0).collect()}
    a, b = df.toDF("k", "y", "x"), df.toDF("o", "y2", "x2")
    near = (F.abs(F.col("y") - F.col("y2")) <= 0.06) & (F.abs(F.col("x") - F.col("x2")) <= 0.07) & (geo.arc_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= 5)
    assert got == {(r.k, r.o) for r in a.crossJoin(b).where(near & (F.col("k") < F.col("o"))).collect()}


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9), (None, 3)], "g string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 1.0)], "g string, u int, v double")
    got = sorted(((r.g or "", r.t, r.matched_on, r.v) for r in asof_join(left, right, ["g"], "t", "u", ["v"]).collect()), key=str)
    assert got == [("", 3, None, None), ("a", 1, None, None), ("a", 5, 5, 50.0), ("b", 9, None, None)]


def days(spark, values, kind):
    return spark.createDataFrame([("f", date(2024, 1, 1) + timedelta(i), v) for i, v in enumerate(values)], f"fuel_type string, market_date date, x {kind}")


def test_series(spark):
    w = series(["fuel_type"], "market_date")
    since = with_rows_since(days(spark, [False, False, True, False, False, False, True], "boolean"), F.col("x"), w, "n").orderBy("market_date").collect()
    assert [r.n for r in since] == [None, None, 0, 1, 2, 3, 0]
    same = with_rows_unchanged(days(spark, [180.0, 180.0, 182.0, 182.0, 182.0, 179.0], "double"), "x", w, "n").orderBy("market_date").collect()
    assert [r.n for r in same] == [0, 1, 0, 1, 2, 0]
    s = D.sensitivity(days(spark, [None, 1.0, 8.0, 2.0, 9.0, 0.0], "double").withColumnRenamed("x", "market_daily_change_cpl"), [7.0]).first()
    assert (s.events, s.market_days, s.median_magnitude, s.min_gap) == (2, 6, 8.5, 2)
    f = D.forecasts(days(spark, [100.0, 102.0, 104.0, 106.0, 108.0], "double").withColumnRenamed("x", "market_median_price_cpl"), 3, trend_rows=5).orderBy("market_date").collect()
    assert f[-1].trend == pytest.approx(114) and f[0].trend is None and f[0].actual == 106


def test_warnings(spark):
    rows = [("f", date(2024, 1, 1 + i), p, j) for i, (p, j) in enumerate([(True, False), (False, False), (False, True), (True, False), (False, False), (False, False), (False, True)])]
    r = D.warnings(spark.createDataFrame(rows, "fuel_type string, market_date date, predicted boolean, jump_today boolean")).first()
    assert (r.warnings, r.matched_warnings, r.false_alarms, r.avg_lead_days, r.jumps_warned) == (2, 1, 1, 2.0, 1)


def test_folds_and_eligibility(spark):
    f = D.walk_forward_folds(date(2025, 1, 1), date(2026, 6, 30), 180, 60, 4)
    assert f[0][2:] == (date(2025, 6, 29), date(2025, 6, 30), date(2025, 8, 28)) and len(f) == 4
    assert D.walk_forward_folds(date(2025, 1, 1), date(2025, 2, 1), 180, 60, 4) == []
    with pytest.raises(ValueError):
        D.walk_forward_folds(date(2025, 1, 1), date(2025, 2, 1), 0, 60, 4)
    rows = spark.createDataFrame([(10, 0), (100, 25), (5, 3), (30, 3), (0, 0)], "total_observations long, extreme_changes long")
    got = [(r.is_eligible, r.exclusion_reason) for r in D.eligibility(rows, SeriesParams()).collect()]
    assert got[:4] == [(False, "insufficient_history"), (False, "excessive_volatility"), (False, "insufficient_history+excessive_volatility"), (True, None)]


def test_threshold_choice(spark):
    rows = [("a", 0.3, 0.5, 0.4, 1.0, 1.5), ("a", 0.5, 0.4, 0.6, 1.0, 1.2), ("a", 0.6, 0.4, 0.6, 1.0, 1.2), ("a", 0.7, 0.9, 0.9, 20.0, 1.5), ("b", 0.2, 0.9, 0.9, 1.0, None)]
    df = spark.createDataFrame(rows, "fuel_type string, threshold double, recall double, f1 double, false_alarms_per_month double, avg_lead_days double")
    assert sorted(map(tuple, D.threshold_choice(df, ThresholdParams()).collect())) == [("a", 0.5, False), ("b", 0.5, True)]


def test_upserts_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    s = spark.createDataFrame([(2, "B", 2), (3, "c", 2), (3, "c0", 1)], "k int, v string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = upsert.insert_new(t, s, ["k"], "n")
    assert rows(once) == [(1, "a", 1), (2, "b", 1), (3, "c", 2)] == rows(upsert.insert_new(once, s, ["k"], "n"))
    assert rows(upsert.upsert(t, s.where("n = 2"), ["k"])) == [(1, "a", 1), (2, "B", 2), (3, "c", 2)]
    assert rows(upsert.update_columns(t, s.where("n = 2"), ["k"], ["n"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]


def test_quality(spark):
    df = spark.createDataFrame([("1", None, "100", "-33.0", "150.0"), ("2", " ", "50", "x", "150"), ("3", "u", "not_a_number", None, "1"), ("4", "u", None, "-40", "150")], "id string, name string, price string, latitude string, longitude string")
    found = {(r.record_identifier, r.rule_name) for r in quality.issues(df, [quality.not_null("name"), *quality.bounds("price"), *quality.coordinates()], "id", "s", "t").collect()}
    assert found == {("1", "not_null_name"), ("2", "not_null_name"), ("2", "bounds_price"), ("3", "numeric_price"), ("2", "coordinates_numeric"), ("3", "coordinates_missing"), ("4", "coordinates_in_box")}


def test_configured_rules(spark):
    df = spark.createDataFrame([("1", "5", "2024-01-01", "a"), ("2", "-1", "never", "z"), ("3", "x", None, "a")], "id string, n string, d string, c string")
    rules = quality.from_config([{"rule": "greater_than", "column": "n", "value": 0, "severity": "warning"}, {"rule": "is_numeric", "column": "n"}, {"rule": "is_date", "column": "d"}, {"rule": "in_set", "column": "c", "values": ["a"]}, {"rule": "between", "column": "n", "min": 0, "max": 4}])
    found = sorted((r.record_identifier, r.rule_name, r.severity) for r in quality.issues(df, rules, "id", "s", "t").collect())
    assert found == [("1", "bounds_n", "error"), ("2", "above_n", "warning"), ("2", "bounds_n", "error"), ("2", "date_d", "error"), ("2", "in_set_c", "error"), ("3", "date_d", "error"), ("3", "numeric_n", "error")]
    with pytest.raises(ValueError):
        quality.from_config([{"rule": "magic"}])


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ServiceStationName,Address,Suburb,Postcode,Brand,FuelCode,PriceUpdatedDate,Price\nA,1 High St,Hill,0800,B,U91,2025-04-01 12:00:00,180.5\nA,1 High St,Hill,0800,B,U91,never,181\n")
    got = raw.monthly_prices(spark, str(tmp_path / "m.csv")).collect()
    assert got[0].PriceUpdatedDate == "2025-04-01T12:00:00" and got[0].Postcode == "0800" and got[1].PriceUpdatedDate is None
    (tmp_path / "bad.csv").write_text("Address,Price\nx,1\n")
    with pytest.raises(ValueError):
        raw.monthly_prices(spark, str(tmp_path / "bad.csv"))
    sheet = spark.createDataFrame([("2024-01-01", "167.2", "1"), ("note", "x", "2")], ["date", "Sydney", "National\nAverage"])
    assert [(r.city, r.price_cpl, r.product) for r in raw.unpivoted_wholesale(sheet, "date", "ULP").collect()] == [("Sydney", 167.2, "ULP")]
    table = spark.createDataFrame([("1Anzac Day", "Saturday 25 April", "Not applicable")], ["Holiday", "2026", "2027"])
    assert [tuple(r) for r in raw.unpivoted_holidays(table, ["2026", "2027"]).collect()] == [("Anzac Day", date(2026, 4, 25), True)]
    reply = spark.createDataFrame([('{"stations":{"items":[{"code":"7","name":"N","brand":"B","address":"1 A St, HILL NSW 2000","location":{"latitude":-33.5,"longitude":151}}]}}',)], "payload string")
    s = raw.stations(reply).first()
    assert (s.station_id, s.suburb, s.postcode, s.latitude) == ("7", "HILL", "2000", -33.5)
    audit = spark.createDataFrame([], "source_file string, checksum string, finished_at timestamp, status string")
    new = raw.new_files(spark, str(tmp_path / "*.csv"), audit)
    done = new.select("source_file", "checksum", F.current_timestamp().alias("finished_at"), F.lit("success").alias("status"))
    assert new.count() == 2 and raw.new_files(spark, str(tmp_path / "*.csv"), done).count() == 0


def test_features_never_look_ahead(spark):
    rows = [(str(s), f, date(2024, 1, 1) + timedelta(d), 100.0 + (s * 37 + d * d * 13 + len(f)) % 60) for s in range(6) for f in ("U91", "DL") for d in range(25) if (s + d) % 4]
    prices = spark.createDataFrame([(*r[:2], str(r[2]) + " 10:00:00", r[2], r[3]) for r in rows], "station_id string, fuel_type string, observed_at string, observed_date date, price_cpl double")
    tgp = prices.groupBy("fuel_type", F.col("observed_date").alias("tgp_date")).agg((F.avg("price_cpl") - 15).alias("tgp_cpl"))
    holidays = spark.createDataFrame([(date(2024, 1, 1), "x"), (date(2024, 1, 1), "y")], "holiday_date date, holiday_name string")

    def features(until):
        d = P.daily_ohlc(prices.where(F.col("observed_date") <= until))
        return P.market_cycle_features(d.join(P.market_median(d), ["fuel_type", "market_date"]), P.indicative_margin(d, tgp), holidays)

    cut = date(2024, 1, 12)
    assert sorted(map(tuple, features(date(2024, 2, 1)).where(F.col("market_date") <= cut).collect()), key=str) == sorted(map(tuple, features(cut).collect()), key=str)
