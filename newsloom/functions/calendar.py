"""Trading sessions of the New York stock exchange as a dimension of calendar days.

The rules below are public knowledge: weekends, observed holidays, special closures and 13:00 closes. The dimension has
one row per day of the years asked for (some 17,000 for the default span), so it may always be broadcast. Assigning an
instant to a session is then an equi-join on its New York date.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"
YEARS = (1990, 2035)
#: Closures outside the rules, and early closes outside the rules.
CLOSED = """
1994-04-27 2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09
""".split()
EARLY = "1996-07-05 1997-12-26 1999-12-31 2002-07-05 2003-12-26".split()


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _easter(y: int) -> date:
    """By the anonymous Gregorian computus."""
    a, b, c = y % 19, y // 100, y % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(y, f // 31, f % 31 + 1)


def holidays(year: int) -> set[date]:
    def observed(d: date) -> date:
        return d + timedelta({5: -1, 6: 1}.get(d.weekday(), 0))

    new_year = date(year, 1, 1)
    days = {
        new_year + timedelta(new_year.weekday() == 6),  # a Saturday's is not made up
        _nth(year, 2, 0, 3),
        _easter(year) - timedelta(2),
        _nth(year, 6, 0, 1) - timedelta(7),
        observed(date(year, 7, 4)),
        _nth(year, 9, 0, 1),
        _nth(year, 11, 3, 4),
        observed(date(year, 12, 25)),
    }
    if year >= 1998:
        days.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        days.add(observed(date(year, 6, 19)))
    return days


def closes_early(d: date) -> bool:
    eve = (d.month, d.day) in ((12, 24), (7, 3)) and d.weekday() < (5 if d.month == 12 else 4)
    return eve or d == _nth(d.year, 11, 3, 4) + timedelta(1) or d.isoformat() in EARLY


@lru_cache(maxsize=4)
def session_days(first_year: int = YEARS[0], last_year: int = YEARS[1]) -> tuple[tuple[date, datetime, datetime], ...]:
    """(day, open, close) of every session, in UTC."""
    zone, utc = ZoneInfo(ZONE), ZoneInfo("UTC")
    out, day = [], date(first_year, 1, 1)
    off = {h for y in range(first_year, last_year + 2) for h in holidays(y)} | {date.fromisoformat(d) for d in CLOSED}
    while day.year <= last_year:
        if day.weekday() < 5 and day not in off:
            at = [datetime.combine(day, t, zone).astimezone(utc).replace(tzinfo=None) for t in (time(9, 30), time(13) if closes_early(day) else time(16))]
            out.append((day, *at))
        day += timedelta(1)
    return tuple(out)


def dimension(spark: SparkSession, first_year: int = YEARS[0], last_year: int = YEARS[1]) -> DataFrame:
    """cal_date, is_session, open_utc, close_utc, session_label (the day or the next session), next_session (after the
    label), prev_close_utc (of the session before the label; null for the first)."""
    sessions = session_days(first_year, last_year)
    rows, k, day = [], 0, date(first_year, 1, 1)
    while day.year <= last_year and k < len(sessions):
        label, opens, closes = sessions[k]
        is_session = label == day
        rows.append((day, is_session, opens if is_session else None, closes if is_session else None, label, sessions[k + 1][0] if k + 1 < len(sessions) else None, sessions[k - 1][2] if k else None))
        k += is_session
        day += timedelta(1)
    schema = "cal_date date, is_session boolean, open_utc timestamp_ntz, close_utc timestamp_ntz, session_label date, next_session date, prev_close_utc timestamp_ntz"
    return spark.createDataFrame(rows, schema)


def local_date(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz")).cast("date")


def _on_day(df: DataFrame, ts: str, calendar: DataFrame | None) -> DataFrame:
    days = dimension(df.sparkSession) if calendar is None else calendar
    days = days.select(*(F.col(c).alias(f"_{c}") for c in days.columns))
    return df.join(F.broadcast(days), local_date(F.col(ts)) == F.col("_cal_date"), "left")


def _without(df: DataFrame) -> DataFrame:
    return df.drop("_cal_date", "_is_session", "_open_utc", "_close_utc", "_session_label", "_next_session", "_prev_close_utc")


def with_session_label(df: DataFrame, ts: str, name: str = "nyse_session", calendar: DataFrame | None = None) -> DataFrame:
    """Adds the session of an instant: its New York day, or the next session if that day has none. Before and after hours
    stay on their day. Null outside the calendar."""
    return _without(_on_day(df, ts, calendar).withColumn(name, F.col("_session_label")))


def with_target_session(df: DataFrame, ts: str, name: str = "nyse_session", calendar: DataFrame | None = None) -> DataFrame:
    """Adds the session T with close(T-1) <= instant < open(T); null for instants during trading hours."""
    t = F.col(ts).cast("timestamp_ntz")
    target = (
        F.when(~F.col("_is_session"), F.col("_session_label"))
        .when(t < F.col("_open_utc"), F.col("_cal_date"))
        .when(t >= F.col("_close_utc"), F.col("_next_session"))
    )
    return _without(_on_day(df, ts, calendar).withColumn(name, target))


def session_bounds(spark: SparkSession, calendar: DataFrame | None = None) -> DataFrame:
    """nyse_session, lower (null for the first), upper: the news window of each session."""
    days = dimension(spark) if calendar is None else calendar
    return days.where("is_session").select(F.col("cal_date").alias("nyse_session"), F.col("prev_close_utc").alias("lower"), F.col("open_utc").alias("upper"))


def with_market_clock(df: DataFrame, ts: str, calendar: DataFrame | None = None) -> DataFrame:
    """Adds is_open, next_open and next_close as of an instant."""
    days = dimension(df.sparkSession) if calendar is None else calendar
    after = days.where("is_session").select(F.col("cal_date").alias("_d"), F.col("open_utc").alias("_o"), F.col("close_utc").alias("_c"))
    t = F.col(ts).cast("timestamp_ntz")
    here = _on_day(df, ts, days)
    nxt = here.join(F.broadcast(after), F.col("_next_session") == F.col("_d"), "left")
    label = after.select(*(F.col(c).alias(f"{c}l") for c in after.columns))
    both = nxt.join(F.broadcast(label), F.col("_session_label") == F.col("_dl"), "left")
    out = both.withColumns(
        {
            "is_open": F.coalesce((t >= F.col("_open_utc")) & (t < F.col("_close_utc")), F.lit(False)),
            "next_open": F.when(t < F.col("_ol"), F.col("_ol")).otherwise(F.col("_o")),
            "next_close": F.when(t < F.col("_cl"), F.col("_cl")).otherwise(F.col("_c")),
        }
    )
    return _without(out).drop("_d", "_o", "_c", "_dl", "_ol", "_cl")
