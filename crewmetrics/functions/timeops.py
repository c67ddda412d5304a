"""Time model: two clocks, production days, 8-hour shifts, report windows, period labels.

Timestamps carry no zone. Logs are stored in UTC, shift reports in local time. Window
bounds are Python values so that they reach the scan as literals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics import config as C

TO_SHIFT_CLOCK = dt.timedelta(minutes=C.LOCAL_OFFSET_HOURS * 60 - C.DAY_START_MINUTES)
TO_LOCAL = dt.timedelta(hours=C.LOCAL_OFFSET_HOURS)


def ntz(value: dt.datetime | dt.date) -> Column:
    """A zone-less timestamp literal."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))


def to_local(ts: Column) -> Column:
    return ts + F.lit(TO_LOCAL)


def millis_between(start: Column, end: Column) -> Column:
    """Millisecond boundaries crossed from ``start`` to ``end`` (session zone UTC)."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end`` (session zone UTC)."""

    def minute(ts: Column) -> Column:
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(60))

    return minute(end) - minute(start)


# --- shifts -------------------------------------------------------------------


def with_shift(df: DataFrame, ts: str = "time_at") -> DataFrame:
    """Adds the shift clock, the production date and the shift number 0/1/2 of a UTC time."""
    clock = F.col(ts) + F.lit(TO_SHIFT_CLOCK)
    return (
        df.withColumn("shift_clock", clock)
        .withColumn("date", F.to_date("shift_clock"))
        .withColumn("shift", shift_of_hour(F.col("shift_clock")))
    )


def shift_of_hour(ts: Column) -> Column:
    return F.floor(F.hour(ts) / F.lit(C.SHIFT_HOURS)).cast("int")


def shift_label(shift: Column, labels: tuple[str, ...] = C.SHIFT_LABELS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), shift + 1)


# --- report windows -----------------------------------------------------------


def day_column(ts: str) -> str:
    """The column of a relation laid out by the day of its time ``ts``."""
    return f"{ts}_day"


def on_days(df: DataFrame, ts: str, start: dt.datetime | None, end: dt.datetime | None, closed: bool = False) -> DataFrame:
    """``df`` on the days from ``start`` to ``end`` if it is laid out by day, so that other days are not opened.

    It drops no row with a time from ``start`` to before ``end`` (to ``end`` itself if ``closed``); all others are left to the caller.
    """
    day = day_column(ts)
    if day not in df.columns:
        return df
    if start is not None:
        df = df.filter(F.col(day) >= F.lit(start.date()))
    if end is not None:
        last = end if closed else end - dt.timedelta(microseconds=1)
        df = df.filter(F.col(day) <= F.lit(last.date()))
    return df


@dataclass(frozen=True)
class Window:
    """A half-open report window in UTC, and the same window on the local clock."""

    start: dt.datetime
    end: dt.datetime

    def utc(self, ts: str) -> Column:
        return (F.col(ts) >= ntz(self.start)) & (F.col(ts) < ntz(self.end))

    def local(self, ts: str) -> Column:
        return (F.col(ts) >= ntz(self.start + TO_LOCAL)) & (F.col(ts) < ntz(self.end + TO_LOCAL))

    def utc_rows(self, df: DataFrame, ts: str) -> DataFrame:
        """Rows whose UTC time lies in the window."""
        return on_days(df.filter(self.utc(ts)), ts, self.start, self.end)

    def local_rows(self, df: DataFrame, ts: str) -> DataFrame:
        """Rows whose local time lies in the window."""
        return on_days(df.filter(self.local(ts)), ts, self.start + TO_LOCAL, self.end + TO_LOCAL)


class Segments:
    """The time between the first start and the last end of several windows, cut at all of their bounds.

    A segment, numbered from 0, lies in a window wholly or not at all.
    """

    def __init__(self, windows: Sequence[Window]):
        self.windows = list(windows)
        self.hull = Window(min(w.start for w in windows), max(w.end for w in windows))
        self.bounds = sorted({t for w in windows for t in (w.start, w.end)})

    def of(self, ts: str, local: bool = False) -> Column:
        """The segment of a UTC (or local) time, -1 before the first one and the number of segments after the last; NULL for NULL."""
        shift = TO_LOCAL if local else dt.timedelta(0)
        found = F.when(F.col(ts) < ntz(self.bounds[0] + shift), F.lit(-1))
        for i, bound in enumerate(self.bounds[1:]):
            found = found.when(F.col(ts) < ntz(bound + shift), F.lit(i))
        return found.when(F.col(ts).isNotNull(), F.lit(len(self.bounds) - 1)).cast("int")

    def reports(self, segment: str) -> Column:
        """The numbers of the windows that a segment lies in."""
        inside = [[i for i, w in enumerate(self.windows) if w.start <= a and b <= w.end] for a, b in zip(self.bounds, self.bounds[1:])]
        listed = F.array(*[F.array(*[F.lit(i) for i in found]).cast("array<int>") for found in inside])
        return F.get(listed, F.col(segment))

    def end_of(self, report: str) -> Column:
        """The first segment after a window."""
        return F.get(F.array(*[F.lit(self.bounds.index(w.end)) for w in self.windows]), F.col(report))


def add_months(day: dt.datetime, n: int) -> dt.datetime:
    """Calendar shift; anchors fall on day 1 or 26, which every month has."""
    months = day.year * 12 + day.month - 1 + n
    return day.replace(year=months // 12, month=months % 12 + 1)


def pay_window(
    as_of: dt.date,
    months_back: int,
    months_forward: int = 0,
    days_back: int = 0,
    anchor_day: int = 26,
) -> Window:
    """Months around the pay-month anchor (day 26, or 1, at 06:15 local) of a date.

    Months are counted on the local anchor and shifted to UTC afterwards.
    """
    day = as_of - dt.timedelta(days=days_back)
    anchor = dt.datetime(day.year, day.month, anchor_day) + dt.timedelta(
        minutes=C.DAY_START_MINUTES
    )
    return Window(
        add_months(anchor, -months_back) - TO_LOCAL, add_months(anchor, months_forward) - TO_LOCAL
    )


def lookback(as_of: dt.date, unit: str, n: int) -> dt.datetime:
    """Start of the current month or ISO week, ``n`` months or weeks earlier (local clock)."""
    day = dt.datetime(as_of.year, as_of.month, as_of.day)
    if unit == "month":
        return add_months(day.replace(day=1), -n)
    if unit == "week":
        return day - dt.timedelta(days=day.weekday(), weeks=n)
    raise ValueError(f"unknown unit {unit!r}")


def local_since(ts: str, since: dt.datetime, strict: bool = False) -> Column:
    """``ts`` (UTC) on the local clock is at or after ``since``; kept as a bare scan bound."""
    bound = ntz(since - TO_LOCAL)
    return F.col(ts) > bound if strict else F.col(ts) >= bound


def rows_since(df: DataFrame, ts: str, since: dt.datetime, strict: bool = False) -> DataFrame:
    """Rows of ``local_since``."""
    return on_days(df.filter(local_since(ts, since, strict)), ts, since - TO_LOCAL, None)


def date_range(
    ts: str, start: dt.date | None, end: dt.date | None, inclusive: bool = False
) -> Column:
    """Fixed range with open or closed ends; either end may be missing."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= ntz(start) if inclusive else F.col(ts) > ntz(start))
    if end is not None:
        cond = cond & (F.col(ts) <= ntz(end) if inclusive else F.col(ts) < ntz(end))
    return cond


# --- periods ------------------------------------------------------------------


def period_number(ts: Column, kind: str) -> Column:
    """Period of a UTC time as an integer, which is what facts are joined and grouped on.

    ``month`` and ``year_week`` take the year from the local clock but the month or ISO week
    from the UTC clock, as the reports do; ``month_local`` uses one clock.
    """
    local = to_local(ts)
    if kind == "month":
        return F.year(local) * 100 + F.month(ts)
    if kind == "month_local":
        return F.year(local) * 100 + F.month(local)
    if kind == "iso_week":
        return F.extract(F.lit("YEAROFWEEK"), local) * 100 + F.weekofyear(local)
    if kind == "year_week":
        return F.year(local) * 100 + F.weekofyear(ts)
    if kind == "month_no":
        return F.month(ts)
    if kind == "month_no_local":
        return F.month(local)
    raise ValueError(f"unknown period kind {kind!r}")


def period_text(number: Column, kind: str) -> Column:
    """Label of a period number: 2021-05, 2020-W53, or the bare number of a month."""
    if kind in ("month_no", "month_no_local"):
        return number
    dash = "-W" if kind == "iso_week" else "-"
    year = F.floor(number / F.lit(100)).cast("string")
    return F.concat(year, F.lit(dash), F.lpad((number % 100).cast("string"), 2, "0"))


def with_period_text(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("period", period_text(F.col("period"), kind))


def day_type(day: Column, holidays: tuple[str, ...], substitutes: tuple[str, ...]) -> Column:
    """Holiday, weekend or weekday; only Sundays and substitute days are weekend."""

    def listed(days: tuple[str, ...]) -> Column:
        return day.isin([dt.date.fromisoformat(d) for d in days]) if days else F.lit(False)

    return (
        F.when(listed(holidays), "3_Holiday")
        .when(listed(substitutes), "2_Weekend")
        .when(F.dayofweek(day) == 1, "2_Weekend")
        .otherwise("1_Weekday")
    )
