"""Quality rules: each compiles to a condition, and a table's broken rules become rows of one issue table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geo import BOX, in_box
from tidewater.params import values_from_file


#: Prices that are plausible, in cents per litre.
BOUNDS = (80.0, 300.0)


@dataclass(frozen=True)
class Rule:
    """A row breaks it where broken is true; null means that it doesn't."""

    name: str
    column: str
    broken: Column
    severity: str = "error"
    action: str = "quarantined"
    text: str = ""


def not_null(column: str) -> Rule:
    return Rule(f"not_null_{column}", column, F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "", "critical")


def bounds(column: str, low: float = BOUNDS[0], high: float = BOUNDS[1]) -> list[Rule]:
    """Null is skipped; what is no number is quarantined; what is out of bounds is flagged."""
    x = F.col(column).try_cast("double")
    return [
        Rule(f"numeric_{column}", column, F.col(column).isNotNull() & x.isNull()),
        Rule(f"bounds_{column}", column, (x < low) | (x > high), "warning", "flagged"),
    ]


def coordinates(lat: str = "latitude", lon: str = "longitude", box: tuple = BOX) -> list[Rule]:
    a, b = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    return [
        Rule("coordinates_missing", f"{lat},{lon}", missing, "warning", "flagged"),
        Rule("coordinates_numeric", f"{lat},{lon}", ~missing & (a.isNull() | b.isNull())),
        Rule("coordinates_in_box", f"{lat},{lon}", a.isNotNull() & b.isNotNull() & ~in_box(a, b, box), "warning", "flagged"),
    ]


def one_of(column: str, values: list[str]) -> Rule:
    return Rule(f"in_set_{column}", column, F.col(column).isNotNull() & ~F.col(column).isin(*values))


def parses(column: str, kind: str) -> Rule:
    """kind: date or timestamp."""
    return Rule(f"{kind}_{column}", column, F.col(column).try_cast(kind).isNull())


def from_config(entries: list[dict]) -> list[Rule]:
    """Rules from entries such as {"rule": "between", "column": "price", "min": 80, "max": 300, "severity": "warning"}.

    Kinds: not_null, is_numeric, between, greater_than, is_date, is_timestamp, in_set, valid_coordinates (also as valid_nsw_coordinates). An unknown
    kind raises ValueError. in_set takes its values from "values", or from "reference", a file of a list, or of an object, whose values count.
    unique_combination isn't a condition on a row but on all of them: unique_rules() has those entries, for duplicates(). Actions may be named as
    imperatives (quarantine, flag, log); in issues they stand as what was done.
    """
    out = []
    for e in entries:
        if e["rule"] == "unique_combination":
            continue
        kind, column = e["rule"], e.get("column", "")
        x = F.col(column).try_cast("double") if column else None
        made = {
            "not_null": lambda: [not_null(column)],
            "is_numeric": lambda: [Rule(f"numeric_{column}", column, F.col(column).isNotNull() & x.isNull())],
            "between": lambda: [Rule(f"bounds_{column}", column, (x < e["min"]) | (x > e["max"]))],
            "greater_than": lambda: [Rule(f"above_{column}", column, x <= e["value"])],
            "is_date": lambda: [parses(column, "date")],
            "is_timestamp": lambda: [parses(column, "timestamp")],
            "in_set": lambda: [one_of(column, e["values"] if "values" in e else values_from_file(e["reference"]))],
            "valid_coordinates": lambda: coordinates(*e.get("columns", (e.get("latitude", "latitude"), e.get("longitude", "longitude")))),
        }
        made["valid_nsw_coordinates"] = made["valid_coordinates"]
        if kind not in made:
            raise ValueError(f"no rule {kind!r}")
        out += [replace(r, severity=e.get("severity", r.severity), action=done(e.get("action", r.action))) for r in made[kind]()]
    return out


#: What a configured action is called once it was done; fixed values. Of duplicates the latest row stays: the others are dropped.
DONE = {"quarantine": "quarantined", "flag": "flagged", "log": "logged", "deduplicate_keep_latest": "deduplicated"}


def done(action: str) -> str:
    return DONE.get(action, action)


def unique_keys(entries: list[dict]) -> list[list[str]]:
    return [u["columns"] for u in unique_rules(entries)]


def unique_rules(entries: list[dict]) -> list[dict]:
    """columns, severity and action of each unique_combination."""
    return [{"columns": e["columns"], "severity": e.get("severity", "warning"), "action": done(e.get("action", "flag"))} for e in entries if e["rule"] == "unique_combination"]


def configured_issues(rows: DataFrame, entries: list[dict], identifier: str, source: str, target: str) -> DataFrame:
    """issues() of all entries of a configuration, those on combinations of columns included: every row behind the first of its key breaks such a rule."""
    found = issues(rows, from_config(entries), identifier, source, target)
    for u in unique_rules(entries):
        key = u["columns"]
        again = duplicates(rows, key, [identifier])
        made = issue_rows(again, identifier, f"unique_{'_'.join(key)}", u["severity"], ",".join(key), identifier, source, target, u["action"])
        found = found.unionByName(made.select(*found.columns))
    return found


def deduplicated(rows: DataFrame, entries: list[dict], latest: list) -> DataFrame:
    """rows without those that a unique_combination of the entries with action deduplicate_keep_latest drops: of each key the first in the order latest stays; null counts as empty."""
    for u in unique_rules(entries):
        if u["action"] == "deduplicated":
            w = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in u["columns"])).orderBy(*latest)
            rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows


def issue_rows(rows: DataFrame, identifier: str, rule: str, severity: str, columns: str, value: str, source: str, target: str, action: str | None = None) -> DataFrame:
    """Every row as an issue, of a rule that is no condition on single rows. action: quarantined, or flagged where the severity is less than a warning, if not said."""
    record = F.col(identifier).cast("string")
    action = action or ("quarantined" if severity in ("error", "critical", "warning") else "flagged")
    return rows.select(
        F.sha2(F.concat_ws("||", record, F.lit(rule)), 256).alias("issue_id"), F.lit(source).alias("source_table"), F.lit(target).alias("target_table"), F.lit(rule).alias("rule_name"), F.lit(severity).alias("severity"),
        F.lit(columns).alias("column_name"), record.alias("record_identifier"), F.lit(action).alias("action_taken"), F.col(value).cast("string").alias("raw_value"),
    )


def issues(rows: DataFrame, rules: list[Rule], identifier: str, source: str, target: str) -> DataFrame:
    """A row for each broken rule of each row, in one pass; issue_id is a hash of record and rule, so reruns find it again."""
    found = F.filter(F.array(*(F.when(r.broken, F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.column).alias("column_name"), F.lit(r.action).alias("action_taken"))) for r in rules)), lambda x: x.isNotNull())
    out = rows.select(F.col(identifier).cast("string").alias("record_identifier"), F.inline(found))
    return out.select(F.sha2(F.concat_ws("||", "record_identifier", "rule_name"), 256).alias("issue_id"), F.lit(source).alias("source_table"), F.lit(target).alias("target_table"), "rule_name", "severity", "column_name", "record_identifier", "action_taken")


def duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every row behind the first of its key, in the given order; null counts as empty."""
    w = Window.partitionBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w).cast("long")).where("occurrence > 1")


def pass_rate(issue_count: Column, record_count: Column) -> Column:
    """0 without records."""
    return F.coalesce(F.try_divide(record_count - issue_count, record_count), F.lit(0.0))


def summary(issues: DataFrame) -> DataFrame:
    """Issues by rule, with their status and a JSON of details."""
    g = issues.groupBy("source_table", "target_table", "rule_name", "severity", "column_name").agg(F.count("*").alias("issue_count"))
    status = F.when(F.col("severity").isin("error", "critical"), "fail").otherwise("warn")
    return g.withColumns({"status": status, "details": F.to_json(F.struct("column_name", "issue_count"))})


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()))
