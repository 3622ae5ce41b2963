"""New York trading calendar: rules in plain Python, sessions as a small table for joins."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = ZoneInfo("America/New_York")
#: Closures that no rule gives.
AD_HOC = frozenset(
    map(date.fromisoformat, "1994-04-27 2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09".split())
)


def easter(year: int) -> date:
    """Gregorian Easter Sunday, by the full moon of the Metonic cycle."""
    golden, century = year % 19, year // 100
    solar, lunar = century - century // 4, (8 * century + 13) // 25
    epact = (19 * golden + solar - lunar + 15) % 30
    moon = epact - (1 if epact == 29 or (epact == 28 and golden > 10) else 0)
    weekday = (year + year // 4 + moon + 2 - solar) % 7
    return date(year, 3, 28) + timedelta(days=moon - weekday)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th (or, for -1, last) such weekday of a month; Monday is 0."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7 - 7 * (n + 1))


def _observed(day: date) -> date:
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> set[date]:
    found = {nth_weekday(year, 2, 0, 3), easter(year) - timedelta(days=2), nth_weekday(year, 5, 0, -1), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4)}
    found |= {_observed(date(year, 7, 4)), _observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:  # a Saturday New Year is not made up for
        found.add(_observed(date(year, 1, 1)))
    if year >= 1998:
        found.add(nth_weekday(year, 1, 0, 3))
    if year >= 2022:
        found.add(_observed(date(year, 6, 19)))
    return {d for d in found | {d for d in AD_HOC if d.year == year} if d.weekday() < 5}


def early_closes(year: int) -> set[date]:
    days = {date(year, 7, 3), nth_weekday(year, 11, 3, 4) + timedelta(days=1), date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def sessions(start: date, end: date) -> list[date]:
    closed = set().union(*(holidays(y) for y in range(start.year, end.year + 1)))
    days = (start + timedelta(days=k) for k in range((end - start).days + 1))
    return [d for d in days if d.weekday() < 5 and d not in closed]


def is_session(day: date) -> bool:
    return day.weekday() < 5 and day not in holidays(day.year)


def next_session(day: date) -> date:
    day += timedelta(days=1)
    return day if is_session(day) else next_session(day)


def previous_session(day: date) -> date:
    day -= timedelta(days=1)
    return day if is_session(day) else previous_session(day)


def close_time(day: date) -> datetime:
    return datetime.combine(day, time(13 if day in early_closes(day.year) else 16), ZONE)


def session_table(spark: SparkSession, start: date, end: date) -> DataFrame:
    """ts, d (number of the session), is_early_close, close_utc."""
    rows = [(datetime.combine(s, time()), k + 1, s in early_closes(s.year), close_time(s).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)) for k, s in enumerate(sessions(start, end))]
    return spark.createDataFrame(rows, "ts timestamp_ntz, d long, is_early_close boolean, close_utc timestamp_ntz").withColumns({"ts": F.col("ts").cast("timestamp"), "close_utc": F.col("close_utc").cast("timestamp")})


def missing_sessions(bars: DataFrame, table: DataFrame) -> DataFrame:
    """Per symbol, the sessions between its first and last bar on which it has none."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    expected = span.join(F.broadcast(table.select("ts")), F.col("ts").between(F.col("a"), F.col("b"))).select("symbol", "ts")
    return expected.join(bars.select("symbol", F.date_trunc("day", "ts").alias("ts")), ["symbol", "ts"], "left_anti")
