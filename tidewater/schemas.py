"""Table definitions as StructTypes; DDL is generated from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE = "_ingested_at timestamp, _source_name string, _source_url string, _source_file string, _source_record_hash string, _pipeline_run_id string"
KEY = "station_id string, fuel_type string, market_date date"
TABLES = {
    "raw_prices": f"station_name string, address string, suburb string, postcode string, brand string, fuel_code string, last_updated string, price double, raw_json string, {LINEAGE}",
    "raw_stations": f"station_id string, station_name string, brand string, address string, suburb string, postcode string, latitude double, longitude double, {LINEAGE}",
    "raw_wholesale": f"tgp_date string, terminal string, city string, product string, price_cpl string, {LINEAGE}",
    "raw_holidays": f"date string, holiday_name string, state string, is_national string, {LINEAGE}",
    "ingestion_audit": "run_id string, source_name string, source_file string, checksum string, started_at timestamp, finished_at timestamp, status string, records_read long, records_written long, records_rejected long, error string",
    "prices": "station_id string, fuel_type string, observed_at timestamp, observed_date date, price_cpl double",
    "stations": "station_id string, station_name string, brand string, address string, suburb string, postcode string, latitude double, longitude double",
    "wholesale": "fuel_type string, tgp_date date, terminal string, city string, tgp_cpl double",
    "holidays": "holiday_date date, holiday_name string, state string, is_national boolean",
    "competitor_pairs": "station_id string, competitor_station_id string, distance_km double",
    "quality_issues": "issue_id string, source_table string, target_table string, rule_name string, severity string, column_name string, record_identifier string, action_taken string",
    "station_daily_market": f"{KEY}, daily_open_price_cpl double, daily_close_price_cpl double, daily_min_price_cpl double, daily_max_price_cpl double, daily_observation_count long, last_observed_at timestamp, market_median_price_cpl double, competitor_count long, local_competitor_min_price_cpl double, local_competitor_max_price_cpl double, local_competitor_median_price_cpl double, local_competitor_mean_price_cpl double, rank_within_local_market long, station_price_percentile double, price_vs_market_median_cpl double, station_vs_competitor_median_cpl double",
    "competitor_positioning": f"{KEY}, competitor_station_id string, competitor_brand string, distance_km double, station_price_cpl double, competitor_price_cpl double, price_difference_cpl double, is_cheapest_local boolean, rank_in_local_market long",
    "indicative_margin": f"{KEY}, retail_price_cpl double, tgp_cpl double, tgp_match_type string, indicative_margin_cpl double, price_tgp_spread_cpl double, margin_vs_7d_avg_cpl double, margin_percentile_30d double",
    "market_cycle_features": f"{KEY}, rolling_7d_min_price double, rolling_7d_max_price double, rolling_7d_mean_price double, rolling_7d_std_price double, rolling_14d_min_price double, rolling_14d_max_price double, rolling_14d_price_change_cpl double, days_since_local_minimum long, days_since_last_detected_jump long, price_position_within_14d_range double, market_median_price_cpl double, market_daily_change_cpl double, tgp_7d_change_cpl double, margin_compression_cpl double, day_of_week long, is_public_holiday boolean",
    "daily_pricing_inputs": f"{KEY}, daily_close_price_cpl double, market_median_price_cpl double, local_competitor_median_price_cpl double, local_competitor_min_price_cpl double, local_competitor_max_price_cpl double, station_price_percentile double, station_vs_competitor_median_cpl double, rank_within_local_market long, competitor_count long, tgp_cpl double, indicative_margin_cpl double, margin_compression_cpl double, rolling_7d_min_price double, rolling_7d_max_price double, rolling_7d_mean_price double, rolling_7d_std_price double, rolling_14d_min_price double, rolling_14d_max_price double, rolling_14d_price_change_cpl double, days_since_local_minimum long, days_since_last_detected_jump long, price_position_within_14d_range double, tgp_7d_change_cpl double, day_of_week long, is_public_holiday boolean",
    "price_jump_labels": "fuel_type string, market_date date, market_median_price_cpl double, market_daily_change_cpl double, jump_today boolean, jump_within_24h boolean, jump_within_48h boolean",
    "model_eligibility": "station_id string, fuel_type string, total_observations long, span_days long, extreme_changes long, extreme_change_rate double, is_eligible boolean, exclusion_reason string",
    "recommendations": f"{KEY}, policy_mode string, action string, reason string, recommendation_status string, guardrail_triggered boolean, jump_signal_used boolean, forecast_signal_used boolean, price double, jump_threshold double, hypothetical_price double, hypothetical_margin double",
    "pipeline_runs": "run_id string, pipeline string, started_at timestamp, finished_at timestamp, status string, error string",
    "quality_results": "run_id string, checked_at timestamp, table_name string, rule_name string, severity string, issue_count long, record_count long, pass_rate double, status string, details string",
    "source_freshness": "source_name string, last_observed_at timestamp, hours_old double, is_stale boolean, checked_at timestamp",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def ddl(name: str, database: str) -> str:
    return f"CREATE TABLE IF NOT EXISTS {_identifier(database)}.{name} ({schema(name).toDDL()}) USING PARQUET"


#: Views by name, over tables of the same database: a CREATE VIEW's text with {db} for it.
VIEWS = {
    "pricing_dashboard": """SELECT r.station_id, s.brand, s.postcode, r.fuel_type, r.market_date, r.action, r.recommendation_status, r.hypothetical_price,
        CASE r.recommendation_status WHEN 'disabled_unsafe' THEN concat('No wholesale margin guards ', r.fuel_type, ': for information only.')
            WHEN 'watch_only' THEN concat(r.fuel_type, ' is watched only: advisory.') END AS warning_message
        FROM {db}.recommendations r LEFT JOIN {db}.stations s ON s.station_id = r.station_id""",
    "latest_recommendations": """SELECT * FROM {db}.recommendations r WHERE market_date = (SELECT max(market_date) FROM {db}.recommendations)""",
    "failed_runs": """SELECT * FROM {db}.pipeline_runs WHERE status = 'failed'""",
}


def create_all(spark: SparkSession, database: str) -> None:
    """The database with all tables; what is there already stays, and old tables gain the columns that they lack."""
    _identifier(database)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in TABLES:
        spark.sql(ddl(name, database))
    evolve(spark, database)


def create_views(spark: SparkSession, database: str) -> None:
    """All views over the database's tables, which must be there; a view that is there already is made anew."""
    for name in VIEWS:
        spark.sql(view_ddl(name, database))


def _identifier(name: str) -> str:
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no identifier")
    return name


def view_ddl(name: str, database: str) -> str:
    return f"CREATE OR REPLACE VIEW {_identifier(database)}.{_identifier(name)} AS {VIEWS[name].format(db=database)}"


def missing_columns(spark: SparkSession, name: str, database: str) -> list[T.StructField]:
    """The columns of the definition that the catalog's table lacks. A column of another type than defined raises ValueError."""
    there = {f.name: f.dataType for f in spark.table(f"{_identifier(database)}.{_identifier(name)}").schema}
    if wrong := [f.name for f in schema(name) if there.get(f.name, f.dataType) != f.dataType]:
        raise ValueError(f"{database}.{name} has columns of another type: {wrong}")
    return [f for f in schema(name) if f.name not in there]


def evolve(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """Add to every table of the database the columns that it lacks, null in its rows; by table, the columns that were added. Tables that don't exist are left out."""
    added = {}
    for name in TABLES:
        if spark.catalog.tableExists(f"{_identifier(database)}.{name}") and (new := missing_columns(spark, name, database)):
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
            added[name] = [f.name for f in new]
    return added


def described(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, is_view, column_name, data_type, position) of everything in the database, as the catalog has it."""
    rows = []
    for t in spark.catalog.listTables(_identifier(database)):
        if not t.isTemporary:
            for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}")):
                rows.append((t.name, t.tableType == "VIEW", c.name, c.dataType, i + 1))
    return spark.createDataFrame(rows, "table_name string, is_view boolean, column_name string, data_type string, position int")


def drop_all(spark: SparkSession, database: str) -> None:
    """The database's tables and views of ours, for a rebuild; others stay."""
    for name in VIEWS:
        spark.sql(f"DROP VIEW IF EXISTS {_identifier(database)}.{name}")
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def evolved(rows: DataFrame, name: str) -> DataFrame:
    """rows in the table's columns and types: missing ones null, values that don't convert null, others left out."""
    return rows.select(*((F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)))
