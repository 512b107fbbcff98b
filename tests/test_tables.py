import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewater import params, queries_scoring, schemas
from tidewater.operators import quality
from tidewater.operators.lineage import looks_ahead
from tidewater.params import PolicyParams, ThresholdParams
from tidewater.plans import decisions as D
from tidewater.plans import features as P
from tidewater.plans import gold
from tidewater.sources import events as E
from tidewater.sources import raw
from tidewater.sources.holidays import easter

SF = "/root/testdata/sf0.001"


def test_written_tables_equal_plans(spark, tmp_path):
    inputs = E.prices(spark, SF), E.stations(spark, SF), E.wholesale(spark, SF), E.holidays(spark)
    out = gold.write_gold(spark, *inputs, str(tmp_path))
    want = gold.gold_tables(P.daily_ohlc(inputs[0]), *inputs[1:])
    assert set(out) == set(want) == set(gold.KEYS)
    for name, df in out.items():
        assert df.count() == want[name].count(), name
    both = out["daily_pricing_inputs"], want["daily_pricing_inputs"]
    a, b = (x.select(*P.KEY, F.round("rolling_7d_mean_price", 8), F.round("indicative_margin_cpl", 8), "competitor_count") for x in both)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    # A load of one day overwrites that day and no other.
    day = E.prices(spark, SF).where("observed_date = '2024-01-05'").withColumn("price_cpl", F.lit(1.0))
    raw.write_partitions(schemas.evolved(P.station_daily_market(day, inputs[1]), "station_daily_market"), f"{tmp_path}/station_daily_market", ["market_date"])
    again = spark.read.schema(schemas.schema("station_daily_market")).parquet(f"{tmp_path}/station_daily_market")
    assert again.where("daily_close_price_cpl = 1.0").select("market_date").distinct().collect()[0][0] == date(2024, 1, 5)
    assert again.count() == want["station_daily_market"].count()


def test_committed_tables_equal_plans_and_meet_as_they_lie(spark, tmp_path):
    inputs = E.prices(spark, SF), E.stations(spark, SF), E.wholesale(spark, SF), E.holidays(spark)
    before = dict(spark.conf.getAll)
    try:
        out = gold.commit_gold(spark, *inputs, "gold_test", str(tmp_path), buckets=3)
        want = gold.gold_tables(P.daily_ohlc(inputs[0]), *inputs[1:])
        assert set(out) == set(gold.KEYS) and dict(spark.conf.getAll) == before
        for name, df in out.items():
            columns = [c for c in df.columns if not c.endswith(("mean_price", "std_price", "avg_cpl", "percentile_30d", "mean_price_cpl", "compression_cpl"))]  # means may differ in the last digit
            a, b = spark.table(f"gold_test.{name}").select(columns), want[name].select(columns)
            assert df.count() == b.count() and a.exceptAll(schemas.evolved(b, name).select(columns)).count() == 0, name
        t = out["station_daily_market"], out["indicative_margin"], out["market_cycle_features"]
        days = t[0].sparkSession.table("gold_test.market_days")
        for df in (P.daily_pricing_inputs(*t), P.market_cycle_features(*t[:2], inputs[3], days=days)):
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()  # what is small is broadcast
        again = gold.commit_gold(spark, inputs[0].where("fuel_type = 'DL'"), *inputs[1:], "gold_test", str(tmp_path), buckets=3, only=("station_daily_market",))
        assert again["station_daily_market"].select("fuel_type").distinct().collect() == [("DL",)]
    finally:
        spark.sql("DROP DATABASE IF EXISTS gold_test CASCADE")


def test_features_never_look_ahead(spark):
    tables = gold.gold_tables(P.daily_ohlc(E.prices(spark, SF)), E.stations(spark, SF), E.wholesale(spark, SF), E.holidays(spark))
    for name in ("station_daily_market", "indicative_margin", "market_cycle_features", "daily_pricing_inputs"):
        assert not looks_ahead(tables[name]), name
    assert looks_ahead(tables["price_jump_labels"])


def test_incremental_load(spark, tmp_path):
    good = ",".join(raw.PRICE_COLUMNS) + "\nA,1 St,X,2000,B,E10,2024-01-01 10:00:00,170.5\n"
    (tmp_path / "a.csv").write_text(good)
    (tmp_path / "b.csv").write_text("Price,Address\n1,x\n")
    (tmp_path / "c.csv").write_text("More," + good.replace("\nA", "\nm,A"))
    audit = spark.createDataFrame([], "source_file string, checksum string, finished_at timestamp, status string")
    rows, made = raw.load_new(spark, str(tmp_path), audit, "run-1")
    assert [(r.Price, r.FuelCode) for r in rows.collect()] == [(170.5, "E10")] * 2
    found = {r.source_file[-5:]: r for r in made.collect()}
    assert {k: (r.status, r.records_read) for k, r in found.items()} == {"a.csv": ("success", 1), "b.csv": ("failed", 0), "c.csv": ("success", 1)}
    assert "ServiceStationName" in found["b.csv"].error and found["a.csv"].error is None
    seen = spark.createDataFrame(made.collect(), made.schema)
    (tmp_path / "a.csv").write_text(good.replace("170.5", "171.5"))
    rows, made = raw.load_new(spark, str(tmp_path), seen, "run-2")
    assert [r.Price for r in rows.collect()] == [171.5] and sorted(r.source_file[-5:] for r in made.collect()) == ["a.csv", "b.csv"]


def test_files_of_other_kinds(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    raw.write_lines(df, str(tmp_path / "j"))
    raw.write_csv(df, str(tmp_path / "c"))
    for kind, name in (("json", "j"), ("csv", "c")):
        assert sorted(map(tuple, raw.staged(spark, str(tmp_path / name), kind, "k string, v double").collect())) == [("a", 1.5), ("b", None)]


def test_parameters_and_rules_from_files(tmp_path):
    (tmp_path / "p.yml").write_text("policy:\n  min_margin: 1.5\n  automated: [E10]\n  thresholds: {E10: 0.4}\n")
    p = params.from_file(PolicyParams, str(tmp_path / "p.yml"), "policy")
    assert (p.min_margin, p.automated, p.thresholds, p.lead_step) == (1.5, ("E10",), (("E10", 0.4),), 2.0)
    (tmp_path / "t.json").write_text(json.dumps({"min_recall": 0.2}))
    assert params.from_file(ThresholdParams, str(tmp_path / "t.json")).min_recall == 0.2
    rules = {"prices": {"required_columns": ["id"], "validations": {"p": {"column": "price", "rule": "between", "params": {"min": 1, "max": 2}, "severity": "warning"}, "u": {"columns": ["id", "day"], "rule": "unique_combination"}}}}
    (tmp_path / "r.json").write_text(json.dumps(rules))
    entries = params.rules_from_file(str(tmp_path / "r.json"), "prices")
    assert [r.name for r in quality.from_config(entries)] == ["not_null_id", "bounds_price"] and quality.unique_keys(entries) == [["id", "day"]]


def test_table_names_are_identifiers():
    with pytest.raises(ValueError):
        schemas.ddl("prices", "a; drop")
    assert {"station_daily_market", "pipeline_runs", "quality_results", "recommendations"} <= set(schemas.TABLES)


def test_easter():
    known = {1818: (3, 22), 1943: (4, 25), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2019: (4, 21), 2038: (4, 25), 2049: (4, 18)}
    assert {y: (easter(y).month, easter(y).day) for y in known} == known


def test_models_on_held_out_days(spark):
    s = queries_scoring.QUERIES["jump_model_scores"](spark, SF).collect()
    assert s and all(r.market_date > queries_scoring.TRAIN_END and 0 <= r.jump_probability <= 1 for r in s)
    f = queries_scoring.QUERIES["forecast_model_scores"](spark, SF).collect()
    assert f and all(abs(r.forecast_1d - r.market_median_price_cpl) < 60 for r in f)


def test_threshold_limits(spark):
    row = lambda t, recall, f1, alarms, lead: ("E10", t, recall, f1, alarms, lead)
    pick = lambda *rows: tuple(D.threshold_choice(spark.createDataFrame(rows, "fuel_type string, threshold double, recall double, f1 double, false_alarms_per_month double, avg_lead_days double")).first())[1:]
    assert pick(row(0.3, 0.9, 0.5, 7.0, 1.5), row(0.4, 0.5, 0.4, 5.0, 1.0), row(0.5, 0.2, 0.9, 1.0, 2.0)) == (0.4, False)
    assert pick(row(0.3, 0.9, 0.5, 5.0, 0.9), row(0.4, 0.9, 0.5, 5.0, None)) == (0.5, True)
