"""Reports kept in order: any page is whole, and is read from the parts it lies in."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crewmetrics.sources import pages


def kept(spark, tmp_path, rows, order, part_rows, **more):
    path = str(tmp_path / "report")
    df = spark.createDataFrame(rows, "k int, v string, x double")
    pages.write_pages(df.repartition(5), path, order, part_rows, **more)
    return path


def stored(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_pages_are_those_of_the_sorted_report(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, *"abcdefghij"]), rng.choice([0.5, 1.5, None])) for _ in range(700)]
    rows += [(3, "hot", 1.0)] * 400  # more copies than a part or a page holds
    path = kept(spark, tmp_path, rows, ("-k", "v"), 20)
    key = lambda r: (r[0] is not None, -(r[0] or 0), r[1] is None, r[1] or "", r[2] is None, r[2] or 0)
    want = sorted(rows, key=key)
    for limit, offset in ((50, 0), (50, 50), (150, 333), (1, 1099), (50, 1090), (5000, 0), (10, 1100), (0, 3)):
        assert [tuple(r) for r in pages.read_page(spark, path, limit, offset).collect()] == want[offset : offset + limit]


def test_a_late_page_opens_no_more_than_the_first(spark, tmp_path):
    path = kept(spark, tmp_path, [(i, str(i), None) for i in range(20_000)], ("-k",), 100)
    parts = len([f for f in os.listdir(f"{path}/rows") if "part=" in f])
    assert parts > 150
    opened = [len(pages.read_page(spark, path, 20, offset).inputFiles()) for offset in (0, 10_000, 19_980)]
    # Beside the parts of rows, the index is one file.
    assert max(opened) <= 3
    assert [r.k for r in pages.read_page(spark, path, 3, 19_990).collect()] == [9, 8, 7]


def test_empty_reports_and_reruns(spark, tmp_path):
    path = kept(spark, tmp_path, [], ("k",), 10)
    page = pages.read_page(spark, path, 10)
    assert page.columns == ["k", "v", "x"] and page.collect() == []
    with pytest.raises(Exception, match="exists"):
        kept(spark, tmp_path, [(1, "a", None)], ("k",), 10)


def test_no_order_is_that_of_all_columns(spark, tmp_path):
    path = kept(spark, tmp_path, [(2, "b", None), (1, None, 0.5), (1, "a", None)], (), 2)
    assert [(r.k, r.v) for r in pages.read_page(spark, path, 9).collect()] == [(1, "a"), (1, None), (2, "b")]


def test_many_parts_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "FOLDERS", 4)
    rows = [(i % 500, f"{i:04}", None) for i in range(3000)] + [(250, "hot", 1.0)] * 300
    path = kept(spark, tmp_path, rows, ("-k", "v"), 20)
    assert len([f for f in os.listdir(f"{path}/rows") if "part=" in f]) == 4  # one for each part would be 151
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for limit, offset in ((50, 0), (30, 1490), (700, 1300), (3300, 0), (9, 3295)):
        assert [tuple(r) for r in pages.read_page(spark, path, limit, offset).collect()] == want[offset : offset + limit]
    assert len(pages.read_page(spark, path, 20, 700).inputFiles()) <= 3


@pytest.mark.parametrize("order", [("-k", "v"), ("k", "-x"), ()])
def test_slices_hold_every_row_once(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(pages, "SAMPLED", 1)
    monkeypatch.setattr(pages, "FOLDERS", 40)
    rng = random.Random(2)
    values = [None, 0.5, -0.0, 1.5, float("nan"), float("inf")]
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, "", *"abcdefghij"]), rng.choice(values)) for _ in range(900)]
    rows += [(3, "hot", 1.0)] * 500 + [(None, None, None)] * 50
    path = kept(spark, tmp_path, rows, order, 20, slices=6)
    one = str(tmp_path / "one")
    pages.write_pages(spark.createDataFrame(rows, "k int, v string, x double"), one, order, 20)
    for limit, offset in ((1450, 0), (70, 0), (150, 640), (30, 1420)):
        found, want = ([repr(tuple(r)) for r in pages.read_page(spark, p, limit, offset).collect()] for p in (path, one))
        assert found == want
        assert len(found) == min(limit, 1450 - offset)
    found = [repr(tuple(r)) for r in pages.read_page(spark, path, 2000).collect()]
    assert sorted(found) == sorted(repr(r).replace("-0.0", "0.0") for r in rows)  # grouping makes them equal


def test_slices_divide_the_report_in_its_order(spark, monkeypatch):
    monkeypatch.setattr(pages, "SAMPLED", 1)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=i % 500, microseconds=i), i) for i in range(4000)] + [(None, -1 - i) for i in range(1000)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, n long").withColumn("day", F.to_date("at")).select("day", "at", "n")
    slices = pages._slices(df, ("-day", "at"), 5, ("n",))
    found = [df.where(wanted).collect() for wanted in slices]
    assert len(found) == 5 and sum(map(len, found)) == 5000 and len({r.n for rows in found for r in rows}) == 5000
    assert all(700 < len(rows) < 1300 for rows in found)
    key = lambda r: (r.day is not None, -r.day.toordinal() if r.day else 0, r.at or start, r.n)
    for above, below in zip(found, found[1:]):
        assert max(map(key, above)) < min(map(key, below))


@pytest.mark.parametrize("more", [{}, {"slices": 3}])
def test_the_disk_holds_the_rows_once_and_no_shuffle(spark, tmp_path, more):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())}
    before = held()
    path = kept(spark, tmp_path, [(i % 97, f"{i * 7919 % 20_000:06}", None) for i in range(20_000)], ("-k",), 500, **more)
    assert not {f for f in held() - before if f.startswith("shuffle")}
    assert stored(path) < 1.3 * stored(f"{path}/rows")
    assert pages.read_page(spark, path, 30_000).count() == 20_000


def test_a_row_however_often_it_comes_fills_no_part(spark, tmp_path):
    path = kept(spark, tmp_path, [(1, "hot", 0.5)] * 3000 + [(2, str(i), None) for i in range(40)], ("k",), 10)
    stored_rows = spark.read.parquet(f"{path}/rows")
    assert stored_rows.where("v = 'hot'").count() <= pages.KINDS
    assert stored_rows.agg(F.sum("__copies")).head()[0] == 3040
    assert [r.v for r in pages.read_page(spark, path, 2, 2999).collect()] == ["hot", "0"]
