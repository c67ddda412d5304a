"""Tables in parts: reruns replace their own parts, reports open only the days of their window."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from crewmetrics.functions.timeops import Window, pay_window, rows_since
from crewmetrics.operators.trimmed import DateRange
from crewmetrics.plans import registry
from crewmetrics.sources import parts

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def table(spark, path):
    return sorted(map(tuple, parts.read_parts(spark, path, "id long, period string").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, period string")


def test_a_rerun_replaces_its_periods_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(1, "2021-01"), (2, "2021-02"), (3, "2020-W53"), (4, None), (5, "a b/c=ü"), (2, "2021-02")]
    parts.replace_parts(frame(spark, old), path, "period")
    assert table(spark, path) == sorted(old, key=str)
    before = files(path)
    # January gets other rows, February none any more, week 53 is not covered.
    parts.replace_parts(frame(spark, [(7, "2021-01")]), path, "period", ["2021-01", "2021-02", "1999-01"])
    assert table(spark, path) == sorted([(7, "2021-01"), (3, "2020-W53"), (4, None), (5, "a b/c=ü")], key=str)
    after = files(path)
    assert {f: t for f, t in before.items() if "2021-0" not in f} == {f: t for f, t in after.items() if "2021-0" not in f}
    assert set(parts.parts_of(spark, path, "period")) == {"2021-01", "2020-W53", None, "a b/c=ü"}
    # The same run again, and one that has no rows at all for what it covers.
    parts.replace_parts(frame(spark, [(7, "2021-01")]), path, "period", ["2021-01"])
    parts.replace_parts(frame(spark, []), path, "period", [None, "a b/c=ü"])
    assert table(spark, path) == sorted([(7, "2021-01"), (3, "2020-W53")], key=str)


def test_a_run_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    parts.replace_parts(frame(spark, [(1, "a"), (2, "b")]), path, "period")
    before = files(path)
    bad = spark.range(100).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("a").alias("period"))
    with pytest.raises(Exception, match="lost"):
        parts.replace_parts(bad, path, "period", ["a", "b"])
    assert files(path) == before and table(spark, path) == [(1, "a"), (2, "b")]




def test_windows_open_their_days_alone(spark, tmp_path):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i) for i in range(80)]
    log = spark.createDataFrame([(i, t) for i, t in enumerate([*times, None])], "event_id long, time_at timestamp_ntz")
    path = str(tmp_path / "log")
    parts.write_days(log, path, "time_at")
    laid = parts.read_parts(spark, path, "event_id long, time_at timestamp_ntz, time_at_day date")
    ids = lambda df: sorted(r.event_id for r in df.select("event_id").collect())
    day = lambda n: dt.datetime(2024, 1, n)
    windows = [Window(day(3), day(5)), Window(day(3) + dt.timedelta(hours=23, minutes=15), day(6)), Window(day(28), day(30)), Window(day(5), day(5))]
    for window in windows:
        for rows in (window.utc_rows, window.local_rows):
            assert ids(rows(laid, "time_at")) == ids(rows(log, "time_at"))
    for dates in (DateRange(dt.date(2024, 1, 4), dt.date(2024, 1, 6)), DateRange(dt.date(2024, 1, 4), dt.date(2024, 1, 6), True), DateRange()):
        assert ids(dates.rows(laid, "time_at")) == ids(dates.rows(log, "time_at"))
    for strict in (False, True):
        assert ids(rows_since(laid, "time_at", day(9), strict)) == ids(rows_since(log, "time_at", day(9), strict))
    plan = windows[0].utc_rows(laid, "time_at")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(time_at_day" in plan and "PushedFilters: [IsNotNull(time_at)" in plan
    # Days beyond the window may be unreadable.
    for name, folder in parts.parts_of(spark, path, "time_at_day").items():
        if name not in ("2024-01-03", "2024-01-04"):
            for f in files(folder):
                os.truncate(f, 1)
    fresh = parts.read_parts(spark, path, "event_id long, time_at timestamp_ntz, time_at_day date")
    assert ids(windows[0].utc_rows(fresh, "time_at")) == list(range(8, 16))


def test_the_daily_report_prunes_its_log(spark):
    report = registry.QUERIES["daily_ewt_over_days"](spark, SF)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(time_at_day") == 1
    assert plan.count("PartitionFilters: [isnotnull(shift_start_local_day") == 1
    assert pay_window(dt.date(2024, 1, 10), 2).start.date().isoformat() in plan
