"""Working time kept by production day: a day is added or computed again from its own events alone.

What a day says by itself is stored as mergeable sums per shift, worker and code. The one thing that reaches over
a day's end is the time from a worker's last logout to the next event, on whatever later day that is. So each
worker's first event and open logout of a day are stored beside the sums, and such logouts are closed when a
window is read. A day that gets late rows replaces its own part; no other day is touched.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.timeops import TO_SHIFT_CLOCK, Window, millis_between, shift_of_hour, with_shift
from crewmetrics.operators import activity as A
from crewmetrics.sources import parts

SUMS = "date date, shift int, worker_id long, code int, ms long, first_at timestamp_ntz, last_at timestamp_ntz"
EDGES = "date date, worker_id long, first_at timestamp_ntz, open_at timestamp_ntz, open_code int"


def days_of(window: Window) -> list[dt.date]:
    """The production days of a window whose bounds are the bounds of days."""
    start, end = (t + TO_SHIFT_CLOCK for t in (window.start, window.end))
    if any(t != dt.datetime(t.year, t.month, t.day) for t in (start, end)):
        raise ValueError("the window does not begin and end with a production day")
    return [start.date() + dt.timedelta(days=n) for n in range((end - start).days)]


def day_sums(log: DataFrame, logouts: DataFrame, meals: DataFrame, window: Window, rules: C.ActivityRules = C.RULES_V2) -> DataFrame:
    """``shift_times`` of the window's days, without the time from a logout to an event on a later day."""
    events = with_shift(A.timed_events(log, logouts, meals, rules, window, keep_next=True))
    same_day = F.to_date(F.col("next_at") + F.lit(TO_SHIFT_CLOCK)) == F.col("date")
    own = F.when(F.col("next_at").isNull() | same_day, F.col("runtime_ms"))
    return events.groupBy(*A.SHIFT_KEYS, "code").agg(
        F.sum(own).alias("ms"), F.min("shift_clock").alias("first_at"), F.max("shift_clock").alias("last_at")
    )


def day_edges(log: DataFrame, logouts: DataFrame, window: Window) -> DataFrame:
    """Each worker's first event of a day, and time and code of the logout that nothing follows on that day, if there is one."""
    log, logouts = window.utc_rows(log, "time_at"), window.utc_rows(logouts, "requested_at")
    events = log.select("worker_id", "time_at", F.lit(0).alias("kind"), "event_id", F.lit(None).cast("int").alias("reason_id")).unionByName(
        logouts.select("worker_id", F.col("requested_at").alias("time_at"), F.lit(1).alias("kind"), "event_id", F.col("reason_id").cast("int").alias("reason_id"))
    )
    last = F.max(F.struct("time_at", "kind", "event_id", "reason_id"))
    found = with_shift(events).groupBy("date", "worker_id").agg(F.min("time_at").alias("first_at"), last.alias("last"))
    counted = F.col("last.reason_id").isNotNull() & (F.col("last.reason_id") != C.REASON_END_SHIFT)
    code = F.when(F.col("last.reason_id") == C.REASON_MEAL, C.MEAL).otherwise(C.LOGOUT).cast("int")
    return found.select("date", "worker_id", "first_at", F.when(counted, F.col("last.time_at")).alias("open_at"), F.when(counted, code).alias("open_code"))


def write_days(wh, path: str, window: Window, rules: C.ActivityRules = C.RULES_V2) -> None:
    """Computes the window's days from their own events and puts them in place of what the table at ``path`` has of them.

    A run that is lost before its end is to be repeated; until then a day's sums may be newer than its edges.
    """
    days = days_of(window)
    sums = day_sums(wh.activity_log, wh.logout_requests, wh.meals, window, rules)
    parts.replace_parts(sums, f"{path}/sums", "date", days)
    parts.replace_parts(day_edges(wh.activity_log, wh.logout_requests, window), f"{path}/edges", "date", days)


def read_times(spark: SparkSession, path: str, window: Window) -> DataFrame:
    """The shift aggregates of a window, as ``shift_times`` has them of its events, from the stored days.

    Only parts of the window's days are opened. An open logout is closed by the worker's first event on the next day
    in the window that has any; the window function sees a row per worker and day.
    """
    days = days_of(window)
    if not days:
        return spark.createDataFrame([], SUMS)
    inside = F.col("date").between(F.lit(days[0]), F.lit(days[-1]))
    sums = parts.read_parts(spark, f"{path}/sums", SUMS).where(inside)
    edges = parts.read_parts(spark, f"{path}/edges", EDGES).where(inside)
    following = F.lead("first_at").over(W.partitionBy("worker_id").orderBy("date"))
    closed = edges.withColumn("next_at", following).where(F.col("open_at").isNotNull() & F.col("next_at").isNotNull())
    clock = F.col("open_at") + F.lit(TO_SHIFT_CLOCK)
    gaps = closed.select(
        "date",
        shift_of_hour(clock).alias("shift"),
        "worker_id",
        F.col("open_code").alias("code"),
        millis_between(F.col("open_at"), F.col("next_at")).alias("ms"),
        clock.alias("first_at"),
        clock.alias("last_at"),
    )
    return sums.unionByName(gaps).groupBy(*A.SHIFT_KEYS, "code").agg(
        F.sum("ms").alias("ms"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
