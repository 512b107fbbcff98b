import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators.lineage import looks_ahead
from tidewater.operators.windows import series
from tidewater.plans import features as P
from tidewater.plans import gold
from tidewater.sources import events as E

SF = "/root/testdata/sf0.001"


@pytest.fixture
def base(spark):
    spark.sql("DROP DATABASE IF EXISTS cat_test CASCADE")
    yield "cat_test"
    spark.sql("DROP DATABASE IF EXISTS cat_test CASCADE")


def test_an_old_table_gains_columns_and_keeps_its_rows(spark, base):
    spark.sql("CREATE DATABASE cat_test")
    spark.sql("CREATE TABLE cat_test.stations (station_id string, brand string) USING PARQUET")
    spark.sql("INSERT INTO cat_test.stations VALUES ('1', 'Aster'), ('2', null)")
    schemas.create_all(spark, base)
    schemas.create_views(spark, base)
    t = spark.table("cat_test.stations")
    assert set(t.columns) == set(schemas.schema("stations").names) and sorted((r.station_id, r.brand, r.latitude) for r in t.collect()) == [("1", "Aster", None), ("2", None, None)]
    assert schemas.evolve(spark, base) == {}
    spark.createDataFrame([("3", "Birch", 1.5)], "station_id string, brand string, latitude double").select(*(F.col(c) if c in ("station_id", "brand", "latitude") else F.lit(None).cast("string" if c != "longitude" else "double").alias(c) for c in t.columns)).write.insertInto("cat_test.stations")
    assert spark.table("cat_test.stations").where("latitude = 1.5").count() == 1
    assert {t.name for t in spark.catalog.listTables(base)} == {*schemas.TABLES, *schemas.VIEWS}
    d = schemas.described(spark, base)
    assert d.where("is_view").select("table_name").distinct().count() == len(schemas.VIEWS) and d.where("table_name = 'stations'").count() == len(t.columns)
    schemas.drop_all(spark, base)
    assert spark.catalog.listTables(base) == []


def test_another_type_is_no_evolution(spark, base):
    spark.sql("CREATE DATABASE cat_test")
    spark.sql("CREATE TABLE cat_test.stations (station_id long) USING PARQUET")
    with pytest.raises(ValueError, match="station_id"):
        schemas.evolve(spark, base)
    for bad in ("a b", "x;", "a.b"):
        with pytest.raises(ValueError):
            schemas.create_all(spark, bad)


def test_the_dashboard_by_name(spark, base):
    schemas.create_all(spark, base)
    schemas.create_views(spark, base)
    rows = [("1", "E10", "LEAD", "automated"), ("2", "U91", "HOLD", "watch_only"), ("3", "DL", "FOLLOW", "disabled_unsafe")]
    r = spark.createDataFrame(rows, "station_id string, fuel_type string, action string, recommendation_status string").withColumn("market_date", F.to_date(F.lit("2024-01-05")))
    schemas.evolved(r, "recommendations").write.insertInto("cat_test.recommendations")
    schemas.evolved(spark.createDataFrame([("1", "Aster")], "station_id string, brand string"), "stations").write.insertInto("cat_test.stations")
    found = {x.station_id: (x.brand, x.warning_message) for x in spark.table("cat_test.pricing_dashboard").collect()}
    assert found == {"1": ("Aster", None), "2": (None, "U91 is watched only: advisory."), "3": (None, "No wholesale margin guards DL: for information only.")}
    assert spark.table("cat_test.latest_recommendations").count() == 3 and spark.table("cat_test.failed_runs").count() == 0


def test_no_feature_looks_ahead(spark):
    """All gold tables, column by column: only the labels do, and of them only the targets."""
    tables = gold.gold_tables(P.daily_ohlc(E.prices(spark, SF)), E.stations(spark, SF), E.wholesale(spark, SF), E.holidays(spark))
    assert {n: looks_ahead(t) for n, t in tables.items() if n != "price_jump_labels"} == {n: [] for n in tables if n != "price_jump_labels"}
    assert looks_ahead(tables["price_jump_labels"]) == ["jump_within_24h", "jump_within_48h"]


def test_a_planted_lead_is_found_steps_later(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "k string, t int, x double")
    w = series(["k"], "t")
    steps = df.withColumn("next", F.lead("x").over(w)).withColumn("gap", F.col("next") - F.col("x")).withColumn("big", F.when(F.col("gap") > 1, "y")).drop("next")
    assert looks_ahead(steps) == ["gap", "big"]
    assert looks_ahead(steps.groupBy("k").agg(F.max("big").alias("b"), F.max("x").alias("x"))) == ["b"]
    assert looks_ahead(steps.groupBy("big").agg(F.max("x").alias("x"))) == ["big", "x"]
    assert looks_ahead(steps.where("gap > 0").select("x")) == ["x"], "which rows there are depends on it"
    assert looks_ahead(df.join(steps.select("k", "gap"), "k").select("x", "gap")) == ["gap"]
    assert looks_ahead(df.select("k", "x").union(steps.select("k", "gap"))) == ["x"]
    assert "e" in looks_ahead(steps.select("k", F.explode(F.array("gap")).alias("e")))
    assert looks_ahead(df.withColumnRenamed("t", "market_date").withColumn("m", F.min("x").over(Window.partitionBy("market_date")))) == [], "of one day"
    frames = {"a": w.rowsBetween(-3, 0), "b": w.rowsBetween(0, 2), "c": w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), "d": w, "e": w.rangeBetween(-5, -1)}
    assert looks_ahead(df.select(*(F.sum("x").over(f).alias(n) for n, f in frames.items()))) == ["b", "c"]
    assert looks_ahead(df.select(F.lag("x", -1).over(w).alias("a"), F.lag("x", 2).over(w).alias("b"), F.lead("x", -1).over(w).alias("c"), F.row_number().over(w).alias("d"), F.percent_rank().over(w).alias("e"))) == ["a", "e"]
