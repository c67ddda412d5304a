"""Exact ranks inside groups of any size, without a global sort and without a written table.

Rows are counted by value. Values fall into buckets that are ordered like them and so many that a bucket holds
a sliver of a group, whatever the values; a window over the buckets of a group, whose number does not
grow with the data, says how many rows come before each bucket, one over the values of a bucket how many before
each value. Rows of one value are told apart by ranges of their first tie-breaker, so a value that half of a
hot group shares spans many tasks as well. Nothing runs until the report does.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each power of two of a value.
PER_OCTAVE = 1 << 16
#: Width of the ranges of the first tie-breaker.
RANGE = 1 << 20
_GROUP, _VALUE, _BUCKET, _RANGE = "_group", "_value", "_bucket", "_range"


def bucket(value: Column) -> Column:
    """A whole number that never falls as the double ``value`` rises; NaN is the largest."""

    def size(v: Column) -> Column:  # above 0: doubles begin at 2 ** -1074; infinity shares the last bucket
        return F.floor(F.log2(F.least(v, F.lit(sys.float_info.max))) * PER_OCTAVE) + 1075 * PER_OCTAVE

    return (
        F.when(F.isnan(value), F.lit(1 << 40)).when(value > 0, size(value)).when(value < 0, -size(-value)).otherwise(F.lit(0))
    )


def _keyed(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """Adds the keys of a row's cell; none is NULL, so that they join by equality. NULL values come last."""
    placed = df.withColumn(_GROUP, F.struct(*group)).withColumn(
        _VALUE, F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    )
    within = F.coalesce(F.floor(F.col(ties[0]) / RANGE), F.lit((1 << 63) - 1)) if ties else F.lit(0)
    return placed.withColumn(_RANGE, within)


def _before(keyed: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """For each cell and counter how many counted rows of the group come before it, and how many the group has."""
    names = list(counters)
    cells = keyed.groupBy(_GROUP, bucket(F.col(_VALUE)).alias(_BUCKET), _VALUE, _RANGE).agg(
        *[F.count(F.when(c, 1)).alias(n) for n, c in counters.items()]
    )
    buckets = cells.groupBy(_GROUP, _BUCKET).agg(*[F.sum(n).alias(n) for n in names])
    group = W.partitionBy(_GROUP)
    lower = group.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(
        _GROUP,
        _BUCKET,
        *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"_start_{n}") for n in names],
        *[F.sum(n).over(group).alias(f"_size_{n}") for n in names],
    )
    inside = W.partitionBy(_GROUP, _BUCKET).orderBy(_VALUE, _RANGE).rowsBetween(W.unboundedPreceding, -1)
    return cells.join(starts, [_GROUP, _BUCKET]).select(
        _GROUP,
        _VALUE,
        _RANGE,
        *[(F.col(f"_start_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"_before_{n}") for n in names],
        *[f"_size_{n}" for n in names],
    )


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    counters: Mapping[str, tuple[str, Column]] | None = None,
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """RANK over ``value`` within the group, and the group size: ties share a rank, NULLs are last.

    ``counters`` gives several ranks at once: for each rank's name the name of its group size and which rows count.
    """
    counters = counters or {rank: (size, F.lit(True))}
    keyed = _keyed(df, group, value, ())
    found = keyed.join(_before(keyed, {n: c for n, (_, c) in counters.items()}), [_GROUP, _VALUE, _RANGE])
    return found.select(
        *df.columns,
        *[(F.col(f"_before_{n}") + 1).alias(n) for n in counters],
        *[F.col(f"_size_{n}").alias(s) for n, (s, _) in counters.items()],
    )


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    ties: Sequence[str],
    number: str = "row_no",
    size: str = "group_size",
) -> DataFrame:
    """ROW_NUMBER by ``value`` and ``ties`` within the group, and the group size.

    The first of ``ties`` is a whole number. Together they make the order total, up to identical rows; NULLs come last.
    """
    keyed = _keyed(df, group, value, ties)
    within = W.partitionBy(_GROUP, _VALUE, _RANGE).orderBy(*[F.asc_nulls_last(t) for t in ties])
    found = keyed.join(_before(keyed, {number: F.lit(True)}), [_GROUP, _VALUE, _RANGE])
    return found.select(
        *df.columns,
        (F.col(f"_before_{number}") + F.row_number().over(within)).alias(number),
        F.col(f"_size_{number}").alias(size),
    )
