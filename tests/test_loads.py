import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import params
from tidewater.operators import quality as Q
from tidewater.operators import sketches as S
from tidewater.sources import raw, versions
from tidewater.streaming import ingest

HEAD = ",".join(raw.PRICE_COLUMNS)


def line(name, price, fuel="E10", at="2024-01-01 10:00:00"):
    return f'{name},"1 High St, Hill",X,2000,B,{fuel},{at},{price}\n'


@pytest.fixture
def base(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS load_test")
    yield "load_test"
    spark.sql("DROP DATABASE load_test CASCADE")


def test_files_stream_in_once(spark, base, tmp_path):
    """Reruns read nothing twice; a bad file and a corrupt line fail alone; later files upsert."""
    files = tmp_path / "in"
    files.mkdir()
    run = lambda: ingest.load_files(spark, str(files), str(tmp_path / "at"), "load_test.prices", "load_test.loads", str(tmp_path / "root"), 2).awaitTermination(200)
    (files / "a.csv").write_text("﻿" + HEAD + "\n" + line("A", 170.5) + line("B", "n/a") + line("C", 150.0, at="31/13/2024 1:00") + "\n")
    (files / "b.csv").write_text("Price,Address\n1,x\n")
    (files / "c.csv").write_text("More," + HEAD + "\nm," + line("D", 180.0))
    run()
    prices = lambda: sorted((r.ServiceStationName, r.Price) for r in versions.table(spark, "load_test.prices").collect())
    loads = lambda: {r.source_file[-5:]: (r.status, r.records_read, r.records_rejected, r.error) for r in versions.table(spark, "load_test.loads").collect()}
    assert prices() == [("A", 170.5), ("D", 180.0)]
    first = loads()
    assert first["a.csv"] == ("success", 3, 2, None) and first["c.csv"] == ("success", 1, 0, None)
    assert first["b.csv"][:3] == ("failed", 0, 0) and "ServiceStationName" in first["b.csv"][3]
    at = {r.source_file: r.loaded_at for r in versions.table(spark, "load_test.loads").collect()}
    run()
    assert prices() == [("A", 170.5), ("D", 180.0)] and {r.source_file: r.loaded_at for r in versions.table(spark, "load_test.loads").collect()} == at, "nothing is read twice"
    (files / "d.csv").write_text(HEAD + "\n" + line("A", 171.5) + line("E", 160.0))
    run()
    assert prices() == [("A", 171.5), ("D", 180.0), ("E", 160.0)] and loads()["d.csv"] == ("success", 2, 0, None)
    # A batch that was cut off runs again: the same content.
    lines = spark.createDataFrame([("x/d.csv", HEAD), ("x/d.csv", line("E", 160.0).strip())], "source_file string, value string")
    for _ in range(2):
        ingest.load_batch(lines, "load_test.prices", "load_test.loads", str(tmp_path / "root"))
    assert prices() == [("A", 171.5), ("D", 180.0), ("E", 160.0)]


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "none.csv").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "two.csv").write_text(HEAD + "\n" + line("A", 1) + "Price," + HEAD + "\n")
    (tmp_path / "same.csv").write_text(HEAD + "\n" + line("A", 1) + HEAD + "\n" + line("B", 2))
    audit = spark.createDataFrame([], "source_file string, checksum string, finished_at timestamp, status string")
    rows, made = raw.load_new(spark, str(tmp_path), audit, "r")
    found = {r.source_file.rsplit("/", 1)[-1]: (r.status, r.records_read, r.error) for r in made.collect()}
    assert found == {"none.csv": ("failed", 0, "has no header"), "two.csv": ("failed", 0, "has several headers"), "same.csv": ("success", 2, None)}
    assert sorted(r.ServiceStationName for r in rows.collect()) == ["A", "B"]


def test_a_failed_load_is_a_status(spark):
    out, status = raw.attempted(spark, "r1", "stations", lambda: spark.read.json("/nowhere/at/all"))
    r = status.first()
    assert out is None and (r.run_id, r.source, r.status) == ("r1", "stations", "failed") and "nowhere" in r.error
    out, status = raw.attempted(spark, "r2", "stations", lambda: spark.range(3))
    assert out.count() == 3 and status.first().status == "success" and status.first().error is None


RULES = """
quality_rules:
  prices:
    required_columns: [station_id]
    validations:
      plausible: {column: price, rule: between, params: {min: 80.0, max: 300.0}, severity: warning, action: flag}
      duplicates: {columns: [station_id, day], rule: unique_combination, severity: info, action: deduplicate_keep_latest}
  stations:
    validations:
      place: {columns: [latitude, longitude], rule: valid_nsw_coordinates, severity: warning, action: flag}
      brand: {column: brand, rule: in_set, params: {reference: "config/brands.yml"}, severity: info, action: log}
freshness:
  prices: {max_hours_stale: 36, alert_hours_stale: 24}
  holidays: {max_days_stale: 90, alert_days_stale: 60}
"""


def test_rules_as_files_have_them(spark, tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "config/rules.yml").write_text(RULES)
    (tmp_path / "config/brands.yml").write_text("brands: {aster: Aster, birch: [Birch, BIRCH CO]}\n")
    path = str(tmp_path / "config/rules.yml")
    rows = spark.createDataFrame([(1, "s", 10.0, "d"), (2, "s", 90.0, "d"), (3, None, 100.0, "d")], "id int, station_id string, price double, day string")
    entries = params.rules_from_file(path, "prices")
    got = sorted((r.record_identifier, r.rule_name, r.severity, r.action_taken) for r in Q.configured_issues(rows, entries, "id", "raw", "prices").collect())
    assert got == [("1", "bounds_price", "warning", "flagged"), ("2", "unique_station_id_day", "info", "deduplicated"), ("3", "not_null_station_id", "critical", "quarantined")]
    assert sorted(r.id for r in Q.deduplicated(rows, entries, [F.desc("id")]).collect()) == [2, 3]
    places = spark.createDataFrame([(1, -33.0, 151.0, "Aster"), (2, -10.0, 151.0, "Other"), (3, None, 151.0, "BIRCH CO")], "id int, latitude double, longitude double, brand string")
    got = sorted((r.record_identifier, r.rule_name, r.action_taken) for r in Q.configured_issues(places, params.rules_from_file(path, "stations"), "id", "raw", "stations").collect())
    assert got == [("2", "coordinates_in_box", "flagged"), ("2", "in_set_brand", "logged"), ("3", "coordinates_missing", "flagged")]
    assert params.freshness_limits(path) == {"prices": {"stale": 36.0, "warn": 24.0}, "holidays": {"stale": 2160.0, "warn": 1440.0}}


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=60_000), rng.exponential(5, 40_000)]
    rows = spark.createDataFrame([("f", i % 10, float(v)) for i, v in enumerate(x)] + [("f", 3, None), ("f", 3, float("nan")), ("g", 1, None)], "k string, d int, v double").withColumn("day", F.expr("date_add(date'2024-01-01', d)"))
    stored = S.sketched(rows, ["k", "day"], "v")
    one = S.merged(stored, ["k"]).select("k", "n", *(S.quantile("sketch", q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.99))).collect()
    f = next(r for r in one if r.k == "f")
    assert f.n == 100_000 and next(r for r in one if r.k == "g").q50 is None
    s = np.sort(x)
    for q in (0.1, 0.5, 0.99):
        assert abs(np.searchsorted(s, f[f"q{int(100 * q)}"]) / len(s) - q) < 2 * S.rank_error()
    three = {r.day.day: (r.n, r.m) for r in S.trailing(stored, ["k"], "day", 3).where("k = 'f'").select("day", "n", S.quantile("sketch", 0.5).alias("m")).collect()}
    for d, (n, m) in three.items():
        part = np.sort(np.concatenate([x[i::10] for i in range(max(0, d - 3), d)]))
        assert n == len(part) and abs(np.searchsorted(part, m) / n - 0.5) < 2 * S.rank_error()


def test_small_sketches_are_exact(spark):
    rows = spark.createDataFrame([(random.Random(i).random(),) for i in range(300)], "v double").withColumn("k", F.lit(1))
    got = S.sketched(rows, ["k"], "v").select(S.quantile("sketch", 0.5).alias("m"), S.rank("sketch", F.lit(0.5)).alias("r")).first()
    v = sorted(r.v for r in rows.collect())
    assert got.m == v[149] and abs(got.r - np.mean(np.array(v) <= 0.5)) < 1e-9


def test_lines_are_parsed_once(spark, tmp_path):
    """What is read of a load doesn't parse its lines again, however it is filtered."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "\n" + line("One", "150.5") + line("Two", "n/a"))
    audit = spark.createDataFrame([], "source_file string, checksum string, finished_at timestamp, status string")
    rows, made = raw.load_new(spark, str(tmp_path / "in"), audit, "r1")
    assert "from_csv" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.Price for r in rows.collect()] == [150.5] and [(r.records_read, r.records_rejected) for r in made.collect()] == [(2, 1)]
