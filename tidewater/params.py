"""Parameters of the market operators, with the production values as defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class PolicyParams:
    """Thresholds of the pricing policy in cents per litre, and which fuels it may act on by itself."""

    lead_min_forecast_change: float = 5.0
    lead_step: float = 2.0
    follow_min_overpriced: float = 4.0
    follow_forecast_decline: float = 5.0
    min_margin: float = 2.0
    stale_days: int = 7
    automated: tuple[str, ...] = ("E10", "P98", "DL", "PDL")
    #: Calibrated jump probabilities by fuel; others use default_threshold.
    thresholds: tuple[tuple[str, float], ...] = (("U91", 0.5), ("E10", 0.4), ("P95", 0.5), ("P98", 0.35), ("DL", 0.35), ("PDL", 0.65))
    default_threshold: float = 0.5


@dataclass(frozen=True)
class SeriesParams:
    """Radius of local markets, definition of a jump, and what a series must have to be modelled."""

    radius_km: float = 5.0
    jump: float = 7.0
    extreme_change: float = 100.0
    min_observations: int = 30
    max_extreme_rate: float = 0.10
    default_cycle_days: float = 14.0


@dataclass(frozen=True)
class ThresholdParams:
    """What a jump threshold must reach to be chosen."""

    grid: tuple[float, ...] = tuple(round(0.05 * k, 2) for k in range(1, 20))
    min_recall: float = 0.30
    max_false_alarms: float = 6.0
    min_lead_days: float = 1.0
    fallback: float = 0.5


def _read(path: str):
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml  # only where such files are used

        return yaml.safe_load(f)


def from_file(kind: type, path: str, section: str | None = None):
    """Parameters of a kind from a YAML or JSON file, or a section of it; what it doesn't name keeps its default, what the kind doesn't know raises TypeError."""
    values = _read(path)
    values = values if section is None else values[section]
    return kind(**{k: tuple(map(tuple, v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def rules_from_file(path: str, table: str) -> list[dict]:
    """The entries of a table's quality rules, as operators.quality.from_config takes them: {table: {validations: {name: {column, rule, params, severity, action}}}}, or the same under quality_rules.

    Every column under required_columns is a not_null of critical severity. A reference to another file is read from the file's own folder, its parent's, or as it stands.
    """
    found = _read(path)
    found = found.get("quality_rules", found)
    entries = [{**{k: v for k, v in e.items() if k != "params"}, **e.get("params", {})} for e in found[table]["validations"].values()]
    here = Path(path).resolve().parent
    for e in entries:
        if "reference" in e:
            e["reference"] = str(next((p for p in (here / e["reference"], here.parent / e["reference"]) if p.exists()), e["reference"]))
    return [{"rule": "not_null", "column": c, "severity": "critical"} for c in found[table].get("required_columns", [])] + entries


def values_from_file(path: str) -> list[str]:
    """The strings of a YAML or JSON file: of a list its items, of an object its values, of objects within it theirs."""

    def of(x) -> list[str]:
        if isinstance(x, dict):
            return [v for y in x.values() for v in of(y)]
        return [v for y in x for v in of(y)] if isinstance(x, list) else [str(x)]

    return sorted(set(of(_read(path))))


def freshness_limits(path: str) -> dict[str, dict[str, float]]:
    """By source: hours after which it is stale, and after which to warn; limits in days count 24 hours."""
    out = {}
    for source, limits in _read(path)["freshness"].items():
        hours = lambda kind, limits=limits: float(limits[f"{kind}_hours_stale"]) if f"{kind}_hours_stale" in limits else 24.0 * limits[f"{kind}_days_stale"]
        out[source] = {"stale": hours("max"), "warn": hours("alert")}
    return out
