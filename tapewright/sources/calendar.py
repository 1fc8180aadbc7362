"""Exchange trading days of any year, by the rules in force since 2022.

The holiday rules are arithmetic, so a calendar is computed for the years that are asked
for or that the data holds. Earlier years follow the same rules, except that Juneteenth
starts in 2022; single closings are listed."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Single closings outside the yearly rules (fixed values): days of mourning.
EXTRA_CLOSINGS = (date(2025, 1, 9),)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last_monday(year: int, month: int) -> date:
    following = date(year + month // 12, month % 12 + 1, 1)
    last = following - timedelta(1)
    return last - timedelta(last.weekday())


def _easter(year: int) -> date:
    """Gregorian Easter Sunday by the anonymous (Meeus/Jones/Butcher) rule."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    el = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * el) // 451
    month, day = divmod(h + el - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _observed(day: date) -> date:
    return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> list[date]:
    """New York Stock Exchange full-day holidays."""
    days = [
        _nth_weekday(year, 1, 0, 3), _nth_weekday(year, 2, 0, 3), _easter(year) - timedelta(2),
        _last_monday(year, 5), _observed(date(year, 7, 4)), _nth_weekday(year, 9, 0, 1),
        _nth_weekday(year, 11, 3, 4), _observed(date(year, 12, 25)),
    ]
    new_year = date(year, 1, 1)
    if new_year.weekday() != 5:  # a Saturday New Year is not observed
        days.append(_observed(new_year))
    if year >= 2022:
        days.append(_observed(date(year, 6, 19)))
    return sorted(days + [x for x in EXTRA_CLOSINGS if x.year == year])


def all_holidays(first: int, last: int) -> list[date]:
    """Holidays of the years from first to last. A Saturday New Year's Day is not observed
    in the year before, so no year needs its neighbours."""
    return [d for y in range(first, last + 1) for d in holidays(y)]


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per date, both ends included."""
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(span).alias("dt"))


def _open_days(df: DataFrame, day: str, first: int, last: int) -> DataFrame:
    """Rows of df on trading days; their years lie between first and last.

    About ten holidays a year are sent as a table; Spark chooses the join by its size."""
    closed = df.sparkSession.createDataFrame([(d,) for d in all_holidays(first, last)], "closed date")
    weekdays = df.where(F.weekday(day) < 5)
    return weekdays.join(closed, F.col(day) == F.col("closed"), "left_anti")


def trading_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Trading days between two dates."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first > last:
        raise ValueError(f"{start} is after {end}")
    return _open_days(date_range(spark, start, end), "dt", first.year, last.year)


def only_trading_days(df: DataFrame, day: str = "dt") -> DataFrame:
    """Rows of a table that fall on trading days, whatever years it holds.

    The first and the last year are found in one pass over the date column alone."""
    years = df.agg(F.min(F.year(day)).alias("first"), F.max(F.year(day)).alias("last")).first()
    if years["first"] is None:
        return df.where(F.col(day).isNotNull())
    return _open_days(df, day, max(1, years["first"]), min(9999, years["last"]))
