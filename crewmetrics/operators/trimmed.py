"""Outlier-trimmed efficiency on images done by one worker alone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions import numeric as N
from crewmetrics.functions.text import like_none
from crewmetrics.functions.timeops import date_range, on_days, period_number
from crewmetrics.operators import ranking

GROUP = ("skill_id", "period")
KEYS = ("period", "skill_id", "skill_name")

TRIM_SHARE = Decimal("0.05")
MASTER_SHARE = Decimal("0.25")
PREMASTER_SHARE = Decimal("0.50")
EXPERT_SHARE = Decimal("0.1")


@dataclass(frozen=True)
class DateRange:
    """Fixed report range with open or closed ends."""

    start: dt.date | None = None
    end: dt.date | None = None
    inclusive: bool = False

    def on(self, ts: str):
        return date_range(ts, self.start, self.end, self.inclusive)

    def rows(self, df: DataFrame, ts: str) -> DataFrame:
        start, end = (d and dt.datetime(d.year, d.month, d.day) for d in (self.start, self.end))
        return on_days(df.filter(self.on(ts)), ts, start, end, closed=self.inclusive)


def sole_worker_images(
    reports: DataFrame, skills: DataFrame, dates: DateRange = DateRange()
) -> DataFrame:
    """Images and skills that exactly one worker reported on."""
    kinds = skills.filter(F.col("skill_kind_id") == C.PRODUCTION_SKILL_KIND).select("skill_id")
    return (
        dates.rows(reports, "created_at")
        .filter(F.col("status_id") == C.ACCEPTED_REPORT_STATUS)
        .join(kinds, "skill_id", "left_semi")
        .groupBy("image_id", "skill_id")
        .agg(F.min("worker_id").alias("worker_id"), F.max("worker_id").alias("_last"))
        .filter(F.col("worker_id") == F.col("_last"))
        .drop("_last")
    )


def image_efficiency(
    sole: DataFrame,
    steps: DataFrame,
    workers: DataFrame,
    dates: DateRange = DateRange(),
    period: str = "month_no",
    name_blocks: Sequence[str] = C.TRIM_NAME_BLOCKS,
) -> DataFrame:
    """Actual over expected time of the steps of sole-worker images."""
    kept = workers.filter(like_none("worker_name", name_blocks)).select("worker_id")
    return (
        dates.rows(steps, "assign_at")
        .filter((F.col("actual_ms") > 0) & (F.col("expected_ms") > 0))
        .join(sole, ["image_id", "skill_id", "worker_id"])
        .join(kept, "worker_id", "left_semi")
        .select(
            period_number(F.col("assign_at"), period).alias("period"),
            "skill_id",
            "skill_name",
            "worker_id",
            "image_id",
            "line_no",
            "part_id",
            "assign_at",
            "actual_ms",
            "expected_ms",
            N.ratio(F.col("actual_ms"), F.col("expected_ms")).alias("efficiency"),
        )
    )


def rank_images(images: DataFrame) -> DataFrame:
    """Number of each step by efficiency within skill and period, and the count of steps."""
    ties = ["image_id", "line_no", "part_id", "worker_id", "assign_at", "actual_ms", "expected_ms"]
    return ranking.number_rows(images, GROUP, "efficiency", ties, "image_rank", "image_count")


def trim_by_rank(
    ranked: DataFrame, share: Decimal = TRIM_SHARE, symmetric: bool = False
) -> DataFrame:
    """Drops the best n and the worst n + 1 steps of a group (n and n if symmetric)."""
    rank, count = F.col("image_rank"), F.col("image_count")
    n = N.share_rounded(share, count)
    top = rank <= count - n if symmetric else rank < count - n
    return ranked.withColumn("outliers", n).filter((rank > n) & top)


def worker_efficiency(trimmed: DataFrame) -> DataFrame:
    """Efficiency of a worker per skill and period, numbered from the best."""
    work = (
        trimmed.groupBy(*KEYS, "worker_id")
        .agg(
            F.count("image_id").alias("image_count"),
            F.sum("actual_ms").alias("sum_actual_ms"),
            F.sum("expected_ms").alias("sum_expected_ms"),
        )
        .withColumn("efficiency", N.ratio(F.col("sum_actual_ms"), F.col("sum_expected_ms")))
    )
    return ranking.number_rows(work, GROUP, "efficiency", ["worker_id"], "worker_rank", "worker_count")


def _with_quotas(ranked: DataFrame) -> DataFrame:
    count = F.col("worker_count")
    return (
        ranked.withColumn("masters", N.share_rounded(MASTER_SHARE, count))
        .withColumn("premasters", N.share_rounded(PREMASTER_SHARE, count))
        .withColumn("bottoms", count - F.col("masters") - F.col("premasters"))
    )


QUOTAS = ("worker_count", "masters", "premasters", "bottoms")


def level_quotas(ranked: DataFrame) -> DataFrame:
    """Workers per skill and period, split into quotas of master, premaster and the rest."""
    counted = ranked.groupBy(*KEYS).agg(F.count("worker_id").alias("worker_count"))
    return _with_quotas(counted)


def zone_boundary_values(ranked: DataFrame) -> DataFrame:
    """Efficiency of the worker at the master quota and at the premaster quota."""
    rank, value = F.col("worker_rank"), F.col("efficiency")
    return (
        _with_quotas(ranked)
        .groupBy(*KEYS, *QUOTAS)
        .agg(
            F.max(F.when(rank == F.col("masters"), value)).alias("mastery_zone"),
            F.max(F.when(rank == F.col("premasters"), value)).alias("premastery_zone"),
        )
    )


def worker_levels(ranked: DataFrame) -> DataFrame:
    """Level by position: the master quota, then the premaster quota, then the rest."""
    rank = F.col("worker_rank")
    level = (
        F.when(rank <= F.col("masters"), "Master")
        .when(rank <= F.col("masters") + F.col("premasters"), "Pre-Master")
        .otherwise("Bottom")
    )
    return _with_quotas(ranked).withColumn("mastery_level", level).drop(*QUOTAS[1:])


def expert_bounds(ranked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expert bound as mean of the quota and as value at the quota, with the total efficiency.

    Doubles are averaged as they are; the quota of one skill and period is a tenth of its
    workers.
    """
    rank, value = F.col("worker_rank"), F.col("efficiency")
    quota = F.col("expert_quota")
    fixed = value.cast("decimal(28,12)")
    mean = N.ratio(
        F.sum(F.when(rank <= quota, fixed)), F.count(F.when(rank <= quota, fixed))
    )
    at_quota = N.ratio(
        F.sum(F.when(rank == quota, fixed)), F.count(F.when(rank == quota, fixed))
    )
    return (
        ranked.withColumn("expert_quota", N.share_rounded(EXPERT_SHARE, F.col("worker_count")))
        .groupBy(*keys, "expert_quota")
        .agg(
            N.ratio(F.sum("sum_actual_ms"), F.sum("sum_expected_ms")).alias("efficiency"),
            N.round_half_up(mean, 2).alias("expert_bound_avg"),
            N.round_half_up(at_quota, 2).alias("expert_bound_rank"),
        )
    )
