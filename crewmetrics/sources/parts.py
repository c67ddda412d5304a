"""Tables in parts by day or by report period: written a part at a time, read only where a report looks.

Reports filter a relation that has a column ``<time>_day`` by that column too, so its scan opens the days of
their window and no others (``timeops.on_days``).
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics.functions.timeops import day_column
from crewmetrics.sources.schemas import SCHEMAS

#: The time column whose day a relation is laid out by; shift reports have the local day, the others that in UTC.
DAY_OF = {
    "activity_log": "time_at",
    "logout_requests": "requested_at",
    "meals": "start_at",
    "shift_reports": "shift_start_local",
    "steps": "assign_at",
    "rejections": "rejected_at",
    "work_reports": "created_at",
    "mask_quality": "created_at",
}
_NULL_PART = "__HIVE_DEFAULT_PARTITION__"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def parts_of(spark: SparkSession, path: str, part: str) -> dict[str | None, str]:
    """The folder of each part by its value as text; nothing is read but the names of folders."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = {n: unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{part}=")}
    return {None if value == _NULL_PART else value: f"{path}/{name}" for name, value in found.items()}


def replace_parts(df: DataFrame, path: str, part: str, covered: Iterable[object] = ()) -> None:
    """Writes ``df`` into the table at ``path``, in place of the parts (values of the column ``part``) that it has rows of.

    Parts in ``covered`` that ``df`` has no rows of any more are emptied; all others keep their files. The new files take the
    old ones' place when the write commits, so a task or executor that is lost changes nothing, a failed run leaves the table as
    it was, and a run can be repeated. Rows of a part meet in few tasks, those of a large one in several. ``df`` must not read
    the table itself.
    """
    spark = df.sparkSession
    gone = {None if value is None else str(value) for value in covered}
    before = {value: folder for value, folder in parts_of(spark, path, part).items() if value in gone}
    stale = {}
    if before:
        has = df.select(F.col(part).cast("string")).distinct()
        kept = {r[0] for r in has.where(F.col(part).isNull() | F.col(part).cast("string").isin([v for v in before if v])).collect()}
        stale = {value: folder for value, folder in before.items() if value not in kept}
    spread = df.hint("rebalance", F.col(part))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    for name in stale.values():
        folder, fs = _folder(spark, name)
        fs.delete(folder, True)


def read_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path`` with the columns of ``schema``, its part among them."""
    return spark.read.schema(schema).parquet(path)


def write_days(df: DataFrame, path: str, ts: str, covered: Iterable[object] = ()) -> None:
    """Writes a relation by the day of its time column ``ts``; days that ``df`` has rows of are replaced."""
    replace_parts(df.withColumn(day_column(ts), F.to_date(ts)), path, day_column(ts), covered)


def read_days(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A relation that ``write_days`` wrote, with its column of days."""
    return read_parts(spark, path, f"{SCHEMAS[name]}, {day_column(DAY_OF[name])} date")
