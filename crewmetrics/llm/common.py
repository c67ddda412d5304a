"""Tables in the shared folder, and the words that several operators count."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.conf.set("spark.checkpoint.dir", f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return spark.conf.get("spark.checkpoint.dir")


class Scratch:
    """Tables of one query in the shared folder: read by any executor, rebuilt by none.

    A result that is still to be computed may read them, so they are deleted when the
    application ends, or earlier by ``drop`` where nothing reads them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self._at_exit)

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back; later plans start there."""
        path = self.path()
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, saved: DataFrame) -> None:
        self._delete(saved.scratch_path)

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # the session may have been stopped
            self._delete(self.root)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
