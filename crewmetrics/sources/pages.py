"""Reports kept in order, so that a page far into one costs what its first page does.

A report is written once, range partitioned by its order, with an index that holds the number of the first row of each part.
A page then opens the parts that its rows lie in and no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, NumericType, StringType, StructField, StructType, TimestampNTZType

from crewmetrics.session import delete_folder, shuffles_dropped

PART_ROWS = 100_000
#: Folders that parts are kept in, one for each part, up to this many; more only where each would hold over so many rows.
FOLDERS, FOLDER_ROWS = 1_000, 1_000_000
#: Stored rows of equal ones at most in a slice.
KINDS = 64
#: Slices are cut by so many keys at most, from up to so many rows for each; the sample they are chosen from is this part of a slice.
BOUND_KEYS, BOUND_ROWS, SAMPLED = 8, 200, 16
#: Types of values that text gives back exactly.
BOUND_TYPES = (NumericType, StringType, BooleanType, DateType, TimestampNTZType)
#: Codec of the tables written.
CODEC = "zstd"
# A folder has the name of its part where it holds one.
_COPIES, _FOLDER, _PART, _FIRST, _ROW, _KIND = "__copies", "__part", "__slice", "__first", "__row", "__kind"


def sort_keys(columns: Sequence[str], order: Sequence[str]) -> list[Column]:
    """The named columns, ``-name`` downwards, then all others; NULLs count as the largest value."""
    names = [o.lstrip("-") for o in order]
    keys = [*order, *[c for c in columns if c not in names]]
    return [F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]


def write_pages(
    df: DataFrame, path: str, order: Sequence[str], part_rows: int = PART_ROWS, slices: int = 1, sampled_by: Sequence[str] = ()
) -> None:
    """Writes ``df`` at the new folder ``path`` in parts of about ``part_rows`` different rows, in the order that ``read_page`` reads.

    The report is written in about ``slices`` slices of its order, one after another, so that beside the rows kept the disk holds what one
    slice shuffles and no more. ``df`` is computed once for each slice, filtered by the first columns of its order, and must give the same
    rows each time; with several slices, once more for the rows with certain hashes of ``sampled_by`` (of all columns by default), which
    tell where slices of like size begin. Both are cheap where such a filter reaches the scans.

    Rows of a slice are written as they come and ranges are cut from that table, a folder each. Of a long report a
    folder holds many parts, so that tasks and files do not multiply with it. Equal rows are a few rows
    with a number of copies, so that no row, however often it comes, makes a part large. The index is written last; a
    run that failed has none and is to be repeated at another path. Columns that can't be grouped by, such as maps, are not taken.
    """
    spark = df.sparkSession
    # No rows: it keeps the columns.
    df.where(F.lit(False)).withColumn(_COPIES, F.lit(1).cast("long")).write.parquet(f"{path}/raw")
    keys = sort_keys(df.columns, order)
    folders = 0
    with shuffles_dropped(spark):
        chosen = _slices(df, order, slices, sampled_by) if slices > 1 else [F.lit(True)]
        for n, wanted in enumerate(chosen):
            folders += _write_slice(df.where(wanted), path, n, keys, part_rows, max(1, FOLDERS // len(chosen)), folders)
        _write_index(spark, path, df.schema, order)


def _write_slice(df: DataFrame, path: str, n: int, keys: Sequence[Column], part_rows: int, most: int, first: int) -> int:
    """Adds a slice to the rows kept, in folders from number ``first`` on; returns how many, ``most`` unless each would hold too many rows."""
    spark, raw = df.sparkSession, f"{path}/slice-{n}"
    df.write.option("compression", CODEC).parquet(raw)
    found = spark.read.schema(df.schema).parquet(raw)
    rows = found.count()
    folders = max(1, min(-(-rows // part_rows), max(most, -(-rows // FOLDER_ROWS))))
    # Stretches of the table take turns, so copies of a row are of several kinds and may lie in several ranges. Only rows of one
    # kind are counted together, which takes no other shuffle.
    at = F.monotonically_increasing_id()
    kinds = found.withColumn(_KIND, F.pmod(F.shiftright(at, 16) + F.shiftright(at, 33), F.lit(KINDS)))
    counted = kinds.repartitionByRange(folders, *keys, _KIND).groupBy(*df.columns, _KIND).agg(F.count(F.lit(1)).alias(_COPIES)).drop(_KIND)
    ranges = counted.withColumn(_FOLDER, F.spark_partition_id() + first)
    # The low bits of the id number the rows of a task as they are sorted.
    at = at.bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = ranges.sortWithinPartitions(_FOLDER, *keys).withColumn(_PART, F.floor(at / F.lit(part_rows)))
    sorted_.write.mode("append").option("compression", CODEC).partitionBy(_FOLDER).parquet(f"{path}/rows")
    delete_folder(spark, raw)
    return folders


def _slices(df: DataFrame, order: Sequence[str], slices: int, sampled_by: Sequence[str]) -> list[Column]:
    """Conditions for about ``slices`` successive slices of the order; each row meets one of them."""
    keys = sort_keys(df.columns, order)
    names = [o.lstrip("-") for o in order]
    listed = [*order, *[c for c in df.columns if c not in names]][:BOUND_KEYS]
    types = {f.name: f.dataType for f in df.schema}
    plain = list(takewhile(lambda k: isinstance(types[k.lstrip("-")], BOUND_TYPES), listed))
    if not plain:
        return [F.lit(True)]
    # A sample of the sample that does not depend on the order in which rows come.
    some = df.where(F.pmod(F.xxhash64(*(sampled_by or df.columns)), F.lit(SAMPLED * slices)) == 0)
    some = some.orderBy(F.xxhash64(*df.columns)).limit(BOUND_ROWS * slices).orderBy(*keys)
    rows = [tuple(r) for r in some.select(*[F.col(k.lstrip("-")).cast("string") for k in plain]).collect()]
    bounds = list(dict.fromkeys(rows[len(rows) * i // slices] for i in range(1, slices))) if rows else []

    def sides(bound: Sequence[str | None]) -> list[tuple[Column, Column]]:
        """For each key whether a row's value stands before that of the bound, and whether it is the same; never NULL."""
        found = []
        for key, text in zip(plain, bound, strict=True):
            down, name = key.startswith("-"), key.lstrip("-")
            if text is None:  # the first value downwards, the last upwards
                found.append((F.lit(False) if down else F.col(name).isNotNull(), F.col(name).isNull()))
                continue
            value = F.lit(text).cast(types[name])
            before = F.col(name) > value if down else F.col(name) < value
            found.append((F.coalesce(before, F.lit(down)), F.col(name).eqNullSafe(value)))
        return found

    def before(bound: Sequence[str | None]) -> Column:
        found = F.lit(False)
        for less, same in reversed(sides(bound)):
            found = less | (same & found)
        return found

    chosen = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        wanted = F.lit(True)
        if low:  # what holds for the first key alone reaches the scans
            wanted = wanted & ~sides(low)[0][0] & ~before(low)
        if high:
            wanted = wanted & (sides(high)[0][0] | sides(high)[0][1]) & before(high)
        chosen.append(wanted)
    return chosen


def _write_index(spark: SparkSession, path: str, columns: StructType, order: Sequence[str]) -> None:
    schema = StructType([*columns.fields, StructField(_COPIES, LongType())])
    sizes = _rows(spark, path, schema).groupBy(_FOLDER, _PART).agg(F.sum(_COPIES).alias("rows"))
    # A row for each folder: the one window that isn't split is over these.
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy(_FOLDER).agg(F.sum("rows").alias("rows"))
    starts = starts.select(_FOLDER, before(Window.orderBy(_FOLDER)).alias("start"))
    first = F.col("start") + before(Window.partitionBy(_FOLDER).orderBy(_PART))
    index = sizes.join(starts, _FOLDER).withColumn(_FIRST, first).drop("start").withColumn("order", F.lit("\n".join(order)))
    index.coalesce(1).sortWithinPartitions(_FIRST).write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str, schema, folders: Sequence[int] | None = None) -> DataFrame:
    opened = [f"{path}/rows"] if folders is None else [f"{path}/rows/{_FOLDER}={n}" for n in folders]
    laid = StructType([*schema.fields, StructField(_PART, LongType()), StructField(_FOLDER, IntegerType())])
    return spark.read.schema(laid).option("basePath", f"{path}/rows").parquet(*opened)


def read_page(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows from row ``offset`` on of the report at ``path``, in its order; none beyond its end.

    The index tells which parts to read, no more than the page itself fills and two, and the folders to open. Each part is numbered by itself.
    """
    index = spark.read.schema(f"{_FOLDER} int, {_PART} long, rows long, {_FIRST} long, `order` string").parquet(f"{path}/index")
    schema = spark.read.parquet(f"{path}/raw").schema
    columns = [f.name for f in schema if f.name != _COPIES]
    held = index.where((F.col(_FIRST) < offset + limit) & (F.col(_FIRST) + F.col("rows") > offset)).orderBy(_FIRST).collect()
    if not held:
        return spark.createDataFrame([], schema).select(*columns)
    keys = sort_keys(columns, held[0]["order"].split("\n") if held[0]["order"] else [])
    (low, first), (high, last) = ((r[_FOLDER], r[_PART]) for r in (held[0], held[-1]))
    folder, part = F.col(_FOLDER), F.col(_PART)
    if low == high:  # in this form the file's own index of columns skips the other parts
        wanted = part.between(first, last)
    else:
        wanted = ((folder > low) | (part >= first)) & ((folder < high) | (part <= last))
    rows = _rows(spark, path, schema, sorted({r[_FOLDER] for r in held})).where(wanted)
    so_far = Window.partitionBy(_FOLDER, _PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(index.select(_FOLDER, _PART, _FIRST), [_FOLDER, _PART])
    rows = rows.withColumn(_ROW, F.col(_FIRST) + F.sum(_COPIES).over(so_far))
    start = F.greatest(F.col(_ROW) - F.col(_COPIES), F.lit(offset))
    end = F.least(F.col(_ROW), F.lit(offset + limit))
    copies = F.explode(F.sequence(start, end - 1))
    return rows.where(start < end).select(*columns, copies.alias(_ROW)).orderBy(_ROW).select(*columns)
