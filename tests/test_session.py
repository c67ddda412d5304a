"""Shuffles in proportion to the input, whatever number of partitions the session was given."""

import pytest
from pyspark.sql import functions as F

from crewmetrics import session

INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in (INITIAL, ADVISORY)}
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_partitions_grow_with_the_tables(settings, tmp_path, monkeypatch):
    spark, asked = settings, 8
    for n in (1, 2):
        spark.range(n * 40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(str(tmp_path / str(n)))
    small, large = str(tmp_path / "1"), str(tmp_path / "2")
    assert 0 < session.stored_bytes(spark, small) < session.stored_bytes(spark, large)
    assert session.stored_bytes(spark, small, large, str(tmp_path / "none")) == sum(session.stored_bytes(spark, p) for p in (small, large))
    monkeypatch.setattr(session, "INPUT_BYTES", 1 << 16)
    found = []
    for path in (small, large):
        session.prepare(spark, path)
        found.append(int(spark.conf.get(INITIAL)))
        assert found[-1] == -(-session.stored_bytes(spark, path) // (1 << 16))
    assert asked < found[0] and 1.8 * found[0] < found[1]
    monkeypatch.setattr(session, "INPUT_BYTES", 1 << 40)
    session.prepare(spark, large)
    assert int(spark.conf.get(INITIAL)) == asked  # never fewer than the session's own


def test_a_task_gets_a_bounded_share_of_a_shuffle(settings, tmp_path, monkeypatch):
    spark = settings
    path = str(tmp_path / "rows")
    spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(path)
    monkeypatch.setattr(session, "INPUT_BYTES", 1 << 19)
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 20)
    session.prepare(spark, path)
    grouped = spark.read.parquet(path).groupBy("x").agg(F.max("id").alias("id"))
    out = str(tmp_path / "out")
    grouped.withColumn("task", F.spark_partition_id()).write.parquet(out)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("task").count().collect()]
    assert sum(sizes) == 400_000
    assert max(sizes) < 400_000 / 16  # eight partitions, the session's number, would hold 50,000 each


def test_a_task_scans_a_bounded_part_of_a_table(spark, tmp_path, monkeypatch):
    key = "spark.sql.files.maxPartitionBytes"
    before, path = spark.conf.get(key), str(tmp_path / "rows")
    rows = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1)
    rows.write.option("parquet.block.size", 1 << 20).option("parquet.page.size.row.check.min", 100).parquet(path)
    stored = session.stored_bytes(spark, path)
    try:
        spark.conf.set(key, "1g")
        session.prepare(spark, path)
        assert int(spark.conf.get(key)) == session.SCAN_BYTES  # what a task holds of a scan is no share of the table
        monkeypatch.setattr(session, "SCAN_BYTES", 4 << 20)
        session.prepare(spark, path)
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= stored // (4 << 20)
        sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400_000 and max(sizes) < 400_000 / 3
        spark.conf.set(key, "2m")
        session.prepare(spark, path)
        assert int(spark.conf.get(key)) == 2 << 20  # never more than the session asks for
    finally:
        spark.conf.set(key, before)
