from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.plans import decisions as D
from tidewater.plans import models as M
from tidewater.sources import events
from tidewater.plans import features as P
from tidewater.streaming import daily


def test_models(spark):
    rows = [(f, date(2024, 1, 1) + timedelta(i), float(i % 7), 100.0 + i % 7, i % 7 >= 5) for f in ("U91", "DL") for i in range(70)]
    df = spark.createDataFrame(rows, "fuel_type string, market_date date, a double, y double, jump_within_48h boolean")
    scored = M.jump_probabilities(M.jump_classifier(df, features=["a"], trees=5), df)
    ap = D.average_precision(scored.select("fuel_type", F.col("jump_probability").alias("probability"), F.col("jump_within_48h").alias("actual"))).collect()
    assert len(ap) == 2 and all(r.average_precision > 0.99 for r in ap)
    p = M.predicted_prices(M.price_regressor(df, "y", ["a"], trees=60), df)  # each tree goes a twentieth of the way
    assert p.agg(F.max(F.abs(F.col("y") - F.col("predicted_price")))).first()[0] < 1


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    p = events.prices(spark, sf).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    p.drop("observed_date").orderBy("observed_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("x", "U91", "2024-03-01 00:00:00", 1.0)], "station_id string, fuel_type string, t string, price_cpl double").select("station_id", "fuel_type", F.to_timestamp("t").alias("observed_at"), "price_cpl")
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    daily.write_days(daily.daily_prices(stream), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    columns = ["station_id", "fuel_type", "market_date", "daily_open_price_cpl", "daily_close_price_cpl", "daily_observation_count"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert got == sorted(map(tuple, P.daily_ohlc(p).select(columns).collect()))


def test_schemas(spark):
    spark.sql("DROP DATABASE IF EXISTS tide_test CASCADE")
    schemas.create_all(spark, "tide_test")
    assert {t.name for t in spark.catalog.listTables("tide_test")} == set(schemas.TABLES)
    row = schemas.evolved(spark.createDataFrame([("1", "x")], "station_id string, latitude string"), "stations").first()
    assert row.station_id == "1" and row.latitude is None and row.brand is None
    spark.sql("DROP DATABASE tide_test CASCADE")
