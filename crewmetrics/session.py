"""Session defaults and the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "crewmetrics", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of stored input for each partition of a shuffle, and shuffled bytes (compressed) that adaptive execution gives one task.
INPUT_BYTES, TASK_BYTES = 4 << 20, 8 << 20
#: Bytes of a stored table that one task scans: beyond 200 partitions a shuffle holds the rows of a scan in memory until they are written.
SCAN_BYTES = 32 << 20
#: Partitions of a shuffle at most; above them a task spills what it can't hold.
MOST_PARTITIONS = 20_000


def prepare(spark: SparkSession, *inputs: str) -> None:
    """Runtime settings the operators need in a session made by someone else.

    Zone-less times are compared through epoch millis, so the zone is pinned; skewed joins
    are split even where that costs one more shuffle. A shuffle begins with partitions in proportion to the tables at
    ``inputs``, never fewer than the session asks for, and adaptive execution joins small ones: what a task sorts
    or aggregates does not grow with the input. A scan is cut into parts of ``SCAN_BYTES`` or what the session asks for, if less.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    asked = spark.conf.get("spark.sql.files.maxPartitionBytes")
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(asked)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(asked, SCAN_BYTES)))
    if inputs:
        asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
        needed = min(-(-stored_bytes(spark, *inputs) // INPUT_BYTES), MOST_PARTITIONS)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(asked, needed)))


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of all files at or below ``paths``, in any store that Spark reads; a path that is missing has none."""
    found = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += fs.getContentSummary(place).getLength() if fs.exists(place) else 0
    return found


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return named


def use_folder(spark: SparkSession, folder: str) -> None:
    """Names the shared folder of a local session that has none; anything else keeps its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        if spark.sparkContext._jsc is not None:  # the session may have been stopped
            delete_folder(spark, path)

    atexit.register(delete)
    return path
