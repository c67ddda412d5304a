"""The daily report of several windows at once equals that of each by itself."""

import datetime as dt

import pytest

from crewmetrics import config as C
from crewmetrics.functions.timeops import Segments, Window, pay_window
from crewmetrics.plans import catalogue, reports
from crewmetrics.sources.adapters import driver_warehouse

SF = "/root/testdata/sf0.001"


def at(*args):
    return dt.datetime(*args)


@pytest.mark.parametrize("codes", [C.EWT_CODES, C.ALL_TIME_CODES])
def test_windows_that_overlap_nest_repeat_and_leave_gaps(spark, codes):
    wh = driver_warehouse(spark, SF)
    windows = [
        Window(at(2023, 12, 25, 23, 15), at(2024, 1, 12, 23, 15)),
        Window(at(2024, 1, 5, 4), at(2024, 1, 9, 11, 30)),  # bounds within shifts
        Window(at(2024, 1, 20, 23, 15), at(2024, 1, 24)),
        Window(at(2024, 1, 5, 4), at(2024, 1, 9, 11, 30)),
        Window(at(2030, 1, 1), at(2030, 2, 1)),
    ]
    groups = (2, 3, 4, 5, 8, 998, 999)
    got = reports.report_daily_for_windows(wh, windows, codes=codes, groups=groups).collect()
    rows = lambda found: sorted((tuple(v for k, v in r.asDict().items() if k != "report") for r in found), key=str)
    for i, window in enumerate(windows):
        want = reports.report_daily_working_time(wh, window, codes=codes, groups=groups).collect()
        assert rows(r for r in got if r.report == i) == rows(want)
        assert bool(want) == (i < 4)


def test_one_scan_for_a_year(spark):
    wh = driver_warehouse(spark, SF)
    df = catalogue.daily_for_dates(wh, [dt.date(2024, m, 10) for m in range(1, 13)])
    one = catalogue.run("daily_ewt_2mo", wh, dt.date(2024, 2, 10))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    scans = lambda text: sum("FileScan" in line for line in text.splitlines())
    assert scans(plan(df)) == scans(plan(one))
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_segments_cover_their_windows_wholly(spark):
    windows = [pay_window(dt.date(2024, m, 10), 2) for m in (2, 3, 6)]
    segments = Segments(windows)
    times = sorted({t + dt.timedelta(seconds=s) for t in segments.bounds for s in (-1, 0, 1)})
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "ts timestamp_ntz").withColumn("segment", segments.of("ts"))
    for r in df.withColumn("reports", segments.reports("segment")).collect():
        want = None if r.ts is None else [i for i, w in enumerate(windows) if w.start <= r.ts < w.end]
        assert (r.reports or []) == (want or [])
    with pytest.raises(ValueError):
        reports.report_daily_for_windows(driver_warehouse(spark, SF), [])
