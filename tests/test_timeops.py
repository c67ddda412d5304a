import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewmetrics.functions import numeric as N
from crewmetrics.functions import timeops as T


def at(spark, *texts):
    rows = [(i, dt.datetime.fromisoformat(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, time_at timestamp_ntz")


def test_production_day_begins_at_0615_local(spark):
    df = at(spark, "2020-01-01 23:14:59", "2020-01-01 23:15:00", "2020-01-02 07:15:00")
    got = [(str(r.date), r.shift) for r in T.with_shift(df).orderBy("i").collect()]
    assert got == [("2020-01-01", 2), ("2020-01-02", 0), ("2020-01-02", 1)]


def test_shift_labels(spark):
    df = spark.range(3).select(T.shift_label(F.col("id").cast("int")).alias("x"))
    assert [r.x for r in df.collect()] == ["1_AM", "2_PM", "3_NI"]


@pytest.mark.parametrize(
    "text, kind, label",
    [
        ("2021-01-01 00:00:00", "iso_week", "2020-W53"),
        ("2020-12-31 18:00:00", "month", "2021-12"),  # local year, UTC month
        ("2020-12-31 18:00:00", "month_local", "2021-01"),
        ("2021-01-01 12:00:00", "year_week", "2021-53"),
        ("2021-03-07 12:00:00", "month_no", 3),
        ("2021-03-31 18:00:00", "month_no_local", 4),
        ("2021-01-04 00:00:00", "iso_week", "2021-W01"),
    ],
)
def test_period_labels(spark, text, kind, label):
    df = at(spark, text).select(T.period_number(F.col("time_at"), kind).alias("period"))
    assert T.with_period_text(df, kind).first().period == label


def test_pay_window_is_counted_on_the_local_anchor():
    w = T.pay_window(dt.date(2021, 3, 31), 1, months_forward=1, anchor_day=1)
    assert w.start == dt.datetime(2021, 1, 31, 23, 15)  # 1 February 06:15 local
    assert w.end == dt.datetime(2021, 3, 31, 23, 15)
    w = T.pay_window(dt.date(2021, 1, 5), 12)
    assert (w.start, w.end) == (
        dt.datetime(2020, 1, 25, 23, 15),
        dt.datetime(2021, 1, 25, 23, 15),
    )


def test_pay_window_days_back_picks_an_earlier_month():
    assert T.pay_window(dt.date(2021, 3, 1), 0, days_back=60).end.month == 12


def test_lookback():
    assert T.lookback(dt.date(2021, 2, 17), "month", 4) == dt.datetime(2020, 10, 1)
    assert T.lookback(dt.date(2021, 2, 17), "week", 1) == dt.datetime(2021, 2, 8)
    with pytest.raises(ValueError):
        T.lookback(dt.date(2021, 2, 17), "day", 1)


def test_boundaries_are_counted_not_elapsed_units(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1, 0, 0, 0, 999_900), dt.datetime(2020, 1, 1, 0, 0, 1, 100))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    row = df.select(
        T.millis_between(F.col("a"), F.col("b")).alias("ms"),
        T.minutes_between(F.col("a"), F.col("b") + F.expr("interval 59 second")).alias("min"),
    ).first()
    assert (row.ms, row.min) == (1, 1)


def test_day_types(spark):
    df = spark.createDataFrame(
        [(dt.date(2019, 4, d),) for d in (13, 14, 15, 21, 22)], "date date"
    )
    kinds = df.select(
        T.day_type(F.col("date"), ("2019-04-14",), ("2019-04-15",)).alias("k")
    ).collect()
    assert [r.k for r in kinds] == [
        "1_Weekday",  # a Saturday
        "3_Holiday",
        "2_Weekend",
        "2_Weekend",
        "1_Weekday",
    ]


def test_windows_reach_the_scan_as_literals(spark, tmp_path):
    at(spark, "2020-01-01 00:00:00").write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    window = T.pay_window(dt.date(2020, 1, 5), 1)
    plan = df.filter(window.utc("time_at"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(time_at), GreaterThanOrEqual(time_at," in plan


def test_shares_are_exact(spark):
    from decimal import Decimal

    counts = spark.createDataFrame([(c,) for c in (9, 10, 30, 50, 70)], "c long")
    rows = counts.select(
        N.share_rounded(Decimal("0.05"), F.col("c")).alias("r"),
        N.share_ceiling(Decimal("0.10"), F.col("c")).alias("u"),
    ).collect()
    assert [r.r for r in rows] == [0, 1, 2, 3, 4]
    assert [r.u for r in rows] == [1, 1, 3, 5, 7]
