"""Public holidays by rule."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar: the Sunday behind the first full moon (by the 19-year cycle) from 21 March on."""
    golden, century = year % 19, year // 100
    moon = (19 * golden + century - century // 4 - (8 * century + 13) // 25 + 15) % 30
    moon -= moon // 28 * (1 - moon // 28 * (29 // (moon + 1)) * ((21 - golden) // 11))
    full = date(year, 3, 21) + timedelta(days=moon)
    return full + timedelta(days=7 - (full.weekday() + 1) % 7)


def _monday(year: int, month: int, nth: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=-first.weekday() % 7 + 7 * (nth - 1))


def holidays_of(year: int) -> list[tuple[date, str, bool]]:
    """(date, name, whether all states have it) of New South Wales. Australia Day moves from a weekend to the Monday behind it."""
    sunday, australia = easter(year), date(year, 1, 26)
    moved = australia + timedelta(days=max(0, 7 - australia.weekday()) if australia.weekday() > 4 else 0)
    return [
        (date(year, 1, 1), "New Year's Day", True),
        (moved, "Australia Day" if moved == australia else "Australia Day (observed)", True),
        (sunday - timedelta(days=2), "Good Friday", True),
        (sunday - timedelta(days=1), "Saturday before Easter Sunday", False),
        (sunday, "Easter Sunday", True),
        (sunday + timedelta(days=1), "Easter Monday", True),
        (date(year, 4, 25), "Anzac Day", True),
        (_monday(year, 6, 2), "King's Birthday", True),
        (_monday(year, 8, 1), "Bank Holiday", False),
        (_monday(year, 10, 1), "Labour Day", False),
        (date(year, 12, 25), "Christmas Day", True),
        (date(year, 12, 26), "Boxing Day", True),
    ]


def nsw(spark: SparkSession, years: list[int]) -> DataFrame:
    """holiday_date, holiday_name, is_national."""
    return spark.createDataFrame([h for y in years for h in holidays_of(y)], "holiday_date date, holiday_name string, is_national boolean")
