"""Working time from stored days equals that from all events of the window."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from crewmetrics.functions.timeops import Window
from crewmetrics.operators import activity as A
from crewmetrics.operators import incremental as I

LOG = "event_id long, worker_id long, image_id long, login_type_id int, activity_type_id int, application_name string, runtime_ms long, time_at timestamp_ntz"
OUT = "event_id long, worker_id long, requested_at timestamp_ntz, reason_id int"
MEALS = "event_id long, worker_id long, start_at timestamp_ntz, finish_at timestamp_ntz"
DAY0 = dt.datetime(2024, 1, 1, 23, 15)  # the start of the production day 2024-01-02
DAYS = 8


class Tables:
    def __init__(self, spark, log, out, meals):
        self.activity_log = spark.createDataFrame(log, LOG)
        self.logout_requests = spark.createDataFrame(out, OUT)
        self.meals = spark.createDataFrame(meals, MEALS)


def events(seed):
    rng = random.Random(seed)
    at = lambda: DAY0 + dt.timedelta(seconds=rng.choice([0, 86_399, 86_400, rng.randrange(DAYS * 86_400)]))
    worker = lambda: rng.choice([1, 1, 1, 2, 3, None])
    log = [(i, worker(), rng.choice([0, 9, None]), 1, rng.choice([0, 5, 7, 12, None]), "app", rng.choice([1000, None]), at()) for i in range(60)]
    out = [(i, worker(), at(), rng.choice([None, *range(1, 7)])) for i in range(120)]
    meals = [(i, worker(), at(), rng.choice([None, at()])) for i in range(10)]
    return log + [(99, 1, 0, 1, 5, "app", 5, None)], out + [(999, 1, None, 2)], meals


def day(first, last):
    return Window(DAY0 + dt.timedelta(days=first), DAY0 + dt.timedelta(days=last))


def rows(df):
    return sorted(map(tuple, df.select("date", "shift", "worker_id", "code", "ms", "first_at", "last_at").collect()), key=str)


def whole(wh, window):
    return rows(A.shift_times(A.timed_events(wh.activity_log, wh.logout_requests, wh.meals, window=window)))


@pytest.mark.parametrize("seed", [1, 2])
def test_days_added_in_any_order_and_late_rows(spark, tmp_path, seed):
    log, out, meals = events(seed)
    wh, path = Tables(spark, log, out, meals), str(tmp_path / "t")
    late = Tables(spark, log[::2], out[::2], meals)
    I.write_days(late, path, day(2, 5))
    I.write_days(wh, path, day(5, DAYS))
    I.write_days(wh, path, day(0, 2))
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and not any(f"2024-01-0{n}" in d for n in (4, 5, 6))}
    I.write_days(wh, path, day(2, 5))
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert before and before.items() <= after.items()
    for window in (day(0, DAYS), day(1, 4), day(3, 4)):
        want = whole(wh, window)
        assert want and rows(I.read_times(spark, path, window)) == want


def test_a_day_without_events_any_more_is_emptied(spark, tmp_path):
    log, out, meals = events(3)
    wh, path = Tables(spark, log, out, meals), str(tmp_path / "t")
    I.write_days(wh, path, day(0, DAYS))
    keep = lambda df, ts: df.where(~F.col(ts).between(*(F.lit(str(DAY0 + dt.timedelta(days=n))).cast("timestamp_ntz") for n in (3, 4))))
    wh.activity_log, wh.logout_requests, wh.meals = keep(wh.activity_log, "time_at"), keep(wh.logout_requests, "requested_at"), keep(wh.meals, "start_at")
    I.write_days(wh, path, day(3, 4))
    # What stood at the next day's first instant went from the tables too.
    I.write_days(wh, path, day(4, 5))
    assert rows(I.read_times(spark, path, day(0, DAYS))) == whole(wh, day(0, DAYS))


def test_only_days_of_the_window_are_opened(spark, tmp_path):
    wh, path = Tables(spark, *events(4)), str(tmp_path / "t")
    I.write_days(wh, path, day(0, DAYS))
    plan = I.read_times(spark, path, day(2, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == 2
    assert I.read_times(spark, path, day(2, 2)).collect() == []
    with pytest.raises(ValueError):
        I.days_of(Window(DAY0, DAY0 + dt.timedelta(hours=30)))
