"""Queries on text keys, quality rules, joins of raw and clean tables, and updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import quality as Q
from tidewater.operators import upsert as U
from tidewater.plans import features as P
from tidewater.queries_features import daily, margin, market
from tidewater.queries_sql import with_
from tidewater.sources import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_(sql)
        return f

    return register


PLAIN = "trim(regexp_replace(regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
ADDRESS_KEY = f"{PLAIN.format('address')} || '|' || {PLAIN.format('postcode')}"
RAW_NAME = "case user_id % 6 when 0 then ' ulp ' when 1 then 'Premium 98' when 2 then 'dl' when 3 then 'Hydrogen' when 4 then '' end"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rough rows made of events: names in various spellings, some values out of bounds, missing or no numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    k = F.col("user_id") % 6
    name = F.when(k == 0, " ulp ").when(k == 1, "Premium 98").when(k == 2, "dl").when(k == 3, "Hydrogen").when(k == 4, "")
    price = F.when(F.col("event_id") % 50 == 0, "n/a").when(F.col("event_id") % 51 == 0, None).otherwise(F.round(F.col("value") * 3, 2).cast("string"))
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"), name.alias("fuel"), price.alias("price"))


RAW = f"select event_id, user_id, cast(ts as date) as day, {RAW_NAME} fuel, case when event_id % 50 = 0 then 'n/a' when event_id % 51 = 0 then null else cast(round(value * 3, 2) as varchar) end price from events"


@query(f"select station_id, {ADDRESS_KEY} match_key from stations")
def address_key(spark, sf_dir):
    return E.stations(spark, sf_dir).select("station_id", T.address_key(F.col("address"), F.col("postcode")).alias("match_key"))


@query(r"""select station_id, trim(left(body, length(body) - length(last_part) - 1)) street, upper(trim(regexp_replace(last_part, '\s+', ' ', 'g'))) suburb, postcode
    from (select *, list_extract(string_split(body, ','), -1) last_part from (select station_id, right(address, 4) postcode, left(address, length(address) - length(' NSW 2000')) body from stations) a) b""")
def address_parse(spark, sf_dir):
    return E.stations(spark, sf_dir).select("station_id", T.address_parts(F.col("address")).alias("p")).select("station_id", "p.street", "p.suburb", "p.postcode")


@query(f"select event_id, case when coalesce(fuel, '') = '' then 'UNKNOWN' when upper(trim(fuel)) = 'ULP' then 'U91' when upper(trim(fuel)) = 'PREMIUM 98' then 'P98' when upper(trim(fuel)) = 'DL' then 'DIESEL' else upper(trim(fuel)) end fuel_type from ({RAW}) r")
def fuel_type_map(spark, sf_dir):
    return raw(spark, sf_dir).select("event_id", T.fuel_name(F.col("fuel")).alias("fuel_type"))


@query(f"select event_id, sha256(cast(event_id as varchar) || '|' || trim(coalesce(fuel, '')) || '|' || cast(user_id as varchar)) record_hash, sha256(concat_ws('||', cast(event_id as varchar), fuel, cast(user_id as varchar))) load_hash from ({RAW}) r")
def record_hash(spark, sf_dir):
    f = (F.col("event_id"), F.col("fuel"), F.col("user_id"))
    return raw(spark, sf_dir).select("event_id", T.record_hash(*f).alias("record_hash"), T.record_hash(*f, separator="||").alias("load_hash"))


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Q.not_null("fuel"), *Q.bounds("price"), Q.one_of("fuel", [" ulp ", "dl", "Premium 98"])]
    return Q.issues(raw(spark, sf_dir), rules, "event_id", "raw_prices", "prices")


ISSUES = f"""select sha256(record_identifier || '||' || rule_name) issue_id, 'raw_prices' source_table, 'prices' target_table, rule_name, severity, column_name, record_identifier, action_taken from (
    select cast(event_id as varchar) record_identifier, 'not_null_fuel' rule_name, 'critical' severity, 'fuel' column_name, 'quarantined' action_taken from ({RAW}) r where trim(coalesce(fuel, '')) = ''
    union all select cast(event_id as varchar), 'numeric_price', 'error', 'price', 'quarantined' from ({RAW}) r where price is not null and try_cast(price as double) is null
    union all select cast(event_id as varchar), 'bounds_price', 'warning', 'price', 'flagged' from ({RAW}) r where try_cast(price as double) < 80 or try_cast(price as double) > 300
    union all select cast(event_id as varchar), 'in_set_fuel', 'error', 'fuel', 'quarantined' from ({RAW}) r where fuel not in (' ulp ', 'dl', 'Premium 98')) x"""


@query(ISSUES)
def dq_rules(spark, sf_dir):
    return found_issues(spark, sf_dir)


@query(f"select source_table, target_table, rule_name, severity, column_name, count(*) issue_count, case when severity in ('error', 'critical') then 'fail' else 'warn' end status, '{{\"column_name\":\"' || column_name || '\",\"issue_count\":' || count(*) || '}}' details from ({ISSUES}) i group by source_table, target_table, rule_name, severity, column_name")
def dq_summary(spark, sf_dir):
    return Q.summary(found_issues(spark, sf_dir))


@query("select event_id, occurrence from (select event_id, row_number() over (partition by user_id, event_type, cast(ts as date) order by event_id) occurrence from events) x where occurrence > 1")
def dq_duplicates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    return Q.duplicates(e, ["user_id", "event_type", "day"], ["event_id"]).select("event_id", "occurrence")


@query("select user_id, event_type, cast(ts as date) as day, count(*) n from events group by 1, 2, 3 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n > 1")


@query("""select count(*) row_count, count(distinct station_id) stations, count(distinct fuel_type) fuels, round(100.0::double * count(tgp_cpl) / count(*), 2) tgp_coverage_pct, count(*) filter (indicative_margin_cpl < -50 or indicative_margin_cpl > 100) implausible_margins,
    count(*) filter (tgp_match_type = 'latest_prior_date') prior_date_matches from margin""")
def gold_metrics(spark, sf_dir):
    return margin(spark, sf_dir).agg(
        F.count("*").alias("row_count"), F.count_distinct("station_id").alias("stations"), F.count_distinct("fuel_type").alias("fuels"), F.round(100.0 * F.count("tgp_cpl") / F.count("*"), 2).alias("tgp_coverage_pct"),
        F.count_if((F.col("indicative_margin_cpl") < -50) | (F.col("indicative_margin_cpl") > 100)).alias("implausible_margins"), F.count_if(F.col("tgp_match_type") == "latest_prior_date").alias("prior_date_matches"),
    )


@query("select fuel_type, max(observed_at) last_observed_at, round(date_diff('second', max(observed_at), timestamp '2024-02-01 00:00:00') / 3600.0::double, 3) hours_old, date_diff('second', max(observed_at), timestamp '2024-02-01 00:00:00') / 3600.0::double > 48 is_stale from prices group by 1")
def freshness(spark, sf_dir):
    p = E.prices(spark, sf_dir).groupBy("fuel_type").agg(F.max("observed_at").alias("last_observed_at"))
    hours = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.col("last_observed_at").cast("timestamp"))) / 3600.0
    return p.select("fuel_type", "last_observed_at", F.round(hours, 3).alias("hours_old"), (hours > 48).alias("is_stale"))


@query("select market_date, method, round(price, 4) price from (select market_date, 'low' as method, min(daily_close_price_cpl) price from daily group by 1 union all select market_date, 'high', max(daily_close_price_cpl) from daily group by 1) x")
def unpivot_prices(spark, sf_dir):
    wide = daily(spark, sf_dir).groupBy("market_date").agg(F.min("daily_close_price_cpl").alias("low"), F.max("daily_close_price_cpl").alias("high"))
    return wide.unpivot("market_date", ["low", "high"], "method", "price").withColumn("price", F.round("price", 4))


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def anti_unmatched(spark, sf_dir):
    """Customers without a finished urgent order."""
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    urgent = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey")
    return c.select("c_custkey", "c_nationkey").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("select distinct s_nationkey from supplier s where not exists (select 1 from customer c where c.c_nationkey = s.s_nationkey and c.c_acctbal > 9950)")
def not_exists(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 9950").select(F.col("c_nationkey").alias("s_nationkey"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey").join(c, "s_nationkey", "left_anti").distinct()


@query("select user_id, event_id, event_type, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_record(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return U.latest_row(e, ["user_id"], "ts")


OLD = "select c_custkey, c_nationkey, c_acctbal from customer where c_custkey % 3 <> 0"
NEW = "select c_custkey, c_nationkey, c_acctbal + 1 c_acctbal from customer where c_custkey % 2 = 0"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query(f"select c_custkey, c_nationkey, round(c_acctbal, 2) c_acctbal from (select * from ({OLD}) o where c_custkey not in (select c_custkey from ({NEW}) n) union all {NEW}) x")
def upsert_merge(spark, sf_dir):
    return U.upsert(*versions(spark, sf_dir), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"select c_custkey, c_nationkey, round(c_acctbal, 2) c_acctbal from ({OLD} union all select * from ({NEW}) n where c_custkey not in (select c_custkey from ({OLD}) o)) x")
def insert_only_merge(spark, sf_dir):
    return U.insert_new(*versions(spark, sf_dir), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"select coalesce(o.c_custkey, n.c_custkey) c_custkey, coalesce(o.c_nationkey, n.c_nationkey) c_nationkey, round(coalesce(n.c_acctbal, o.c_acctbal), 2) c_acctbal from ({OLD}) o full join ({NEW}) n using (c_custkey)")
def update_column_merge(spark, sf_dir):
    return U.update_columns(*versions(spark, sf_dir), ["c_custkey"], ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"select c_custkey, c_nationkey, round(c_acctbal, 2) c_acctbal from (select * from ({OLD}) o where c_nationkey not in (select c_nationkey from ({NEW}) n where c_nationkey < 5) union all select * from ({NEW}) n where c_nationkey < 5) x")
def delete_then_insert(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return U.replace_where(old, new.where("c_nationkey < 5"), ["c_nationkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("select 'daily' as name, count(*) n from daily union all select 'market', count(*) from market union all select 'pairs', count(*) from pairs union all select 'stations', count(*) from stations")
def union_counts(spark, sf_dir):
    s = E.stations(spark, sf_dir)
    return Q.counts({"daily": daily(spark, sf_dir), "market": market(spark, sf_dir), "pairs": P.competitor_pairs(s), "stations": s})


@query("select event_id, user_id, ts from events order by ts desc, event_id limit 6")
def top_latest(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(6)


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' payload from events")
def json_payload(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("payload"))


AUDIT = "select o_orderkey run_id, o_orderpriority source, o_orderdate finished_at, o_orderstatus status, cast(o_custkey % 5 as varchar) checksum from orders"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load log made of orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 5).cast("string").alias("checksum"))


@query(f"select source, max(run_id) run_id, checksum from (select *, row_number() over (partition by source order by finished_at desc, run_id desc) n from ({AUDIT}) a where status = 'F') x where n = 1 group by source, checksum")
def last_checksum(spark, sf_dir):
    """The checksum of each source's last successful load."""
    return audit(spark, sf_dir).where("status = 'F'").groupBy("source").agg(F.max_by(F.struct("run_id", "checksum"), F.struct("finished_at", "run_id")).alias("b")).select("source", "b.run_id", "b.checksum")


@query(f"select run_id, source, case when source like '1%' or source like '2%' then 'urgent' when status = 'P' then 'pending' else status end status from ({AUDIT}) a")
def update_case(spark, sf_dir):
    """An UPDATE with CASE as a projection."""
    status = F.when(F.col("source").startswith("1") | F.col("source").startswith("2"), "urgent").when(F.col("status") == "P", "pending").otherwise(F.col("status"))
    return audit(spark, sf_dir).select("run_id", "source", status.alias("status"))


@query("select cast(d as date) holiday_date, dayofweek(cast(d as date)) + 1 day_of_week, year(cast(d as date)) as year, regexp_replace(n, '^[0-9]+', '') holiday_name from (values ('2024-01-01', '1New Year''s Day'), ('2024-01-26', 'Australia Day'), ('2024-04-25', '2Anzac Day'), ('2024-12-25', 'Christmas Day')) h(d, n)")
def holiday_calendar(spark, sf_dir):
    rows = [("2024-01-01", "1New Year's Day"), ("2024-01-26", "Australia Day"), ("2024-04-25", "2Anzac Day"), ("2024-12-25", "Christmas Day")]
    day = F.col("d").try_cast("date")
    return spark.createDataFrame(rows, "d string, n string").select(day.alias("holiday_date"), F.dayofweek(day).cast("long").alias("day_of_week"), F.year(day).cast("long").alias("year"), T.clean_holiday(F.col("n")).alias("holiday_name"))


@query("select station_id, names_agree from (select station_id, case station_id::bigint % 3 when 0 then upper(brand) || ' Hill' when 1 then '' else 'Other' end other, brand, trim(upper(brand)) a, trim(upper(other)) b, a <> '' and b <> '' and (contains(a, b) or contains(b, a)) names_agree from stations) x")
def names_agree(spark, sf_dir):
    other = F.when(F.col("station_id").cast("long") % 3 == 0, F.concat(F.upper("brand"), F.lit(" Hill"))).when(F.col("station_id").cast("long") % 3 == 1, "").otherwise("Other")
    return E.stations(spark, sf_dir).select("station_id", T.names_agree(F.col("brand"), other).alias("names_agree"))
