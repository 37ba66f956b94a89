"""Exchange sessions by rule."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# Closures that no rule gives.
SPECIAL_CLOSURES = (date(2018, 12, 5), date(2025, 1, 9))


def easter(year: int) -> date:
    """Western Easter by the anonymous Gregorian computus."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    offset = epact - weekday
    month = 3 + (offset + 40) // 44
    return date(year, month, offset + 28 - 31 * (month // 4))


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """n from 1; -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def observed(day: date) -> date:
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    new_year = date(year, 1, 1)
    found = {
        nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), easter(year) - timedelta(2), nth_weekday(year, 5, 0, -1),
        observed(date(year, 7, 4)), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(date(year, 12, 25)),
    }
    if new_year.weekday() != 5:  # a Saturday's New Year is not made up for
        found.add(observed(new_year))
    if year >= 2022:
        found.add(observed(date(year, 6, 19)))
    return found | {d for d in SPECIAL_CLOSURES if d.year == year}


def sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(date): weekdays from start to end, both in, that are no holiday."""
    closed = sorted(set().union(*(holidays(y) for y in range(start.year, end.year + 1))))
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS date").where("weekday(date) < 5")
    return days.join(spark.createDataFrame([(d,) for d in closed], "date date"), "date", "left_anti")
