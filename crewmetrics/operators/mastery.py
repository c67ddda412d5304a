"""Rejection-adjusted skill mastery: stats per worker, skill and period, zones and levels.

Worker attributes depend on the worker alone, so name rules and attributes are joined to
the per-worker aggregates and never to the raw steps.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions import numeric as N
from crewmetrics.functions.text import like_none, lookup
from crewmetrics.functions.timeops import ntz, period_number, rows_since
from crewmetrics.operators import ranking

UNIT = ("image_id", "skill_id", "worker_id")
GROUP = ("period", "skill_id")
WORKER_KEYS = ("period", "skill_id", "worker_id")


def step_facts(
    steps: DataFrame,
    since: dt.datetime,
    skills: Sequence[int] = C.MASTERY_SKILLS,
    period: str = "month",
) -> DataFrame:
    """Steps of the listed skills with an expected time, labelled with their period."""
    return (
        rows_since(steps, "assign_at", since)
        .filter((F.col("expected_ms") > 0) & F.col("skill_id").isin(*skills))
        .select(
            *UNIT,
            "skill_name",
            period_number(F.col("assign_at"), period).alias("period"),
            "actual_s",
            "expected_ms",
        )
    )


def named_workers(workers: DataFrame, blocks: Sequence[str] = C.MASTERY_NAME_BLOCKS) -> DataFrame:
    return workers.filter(like_none("worker_name", blocks)).select(
        "worker_id", "worker_name", "joined_date", "office_name"
    )


def skill_steps(facts: DataFrame, workers: DataFrame) -> DataFrame:
    """Step facts with the attributes of their worker."""
    return facts.join(named_workers(workers), "worker_id")


def internal_rejections(
    rejections: DataFrame, since: dt.datetime, period: str = "month"
) -> DataFrame:
    """Rejections by colleagues with a receiver, labelled with the period they fall in."""
    return (
        rejections.filter(F.col("rejected_at") >= ntz(since))
        .filter(F.coalesce(F.col("is_customer"), F.lit(0)) == 0)
        .filter(F.col("receiver_id").isNotNull())
        .select(
            "image_id",
            "skill_id",
            F.col("receiver_id").alias("worker_id"),
            period_number(F.col("rejected_at"), period).alias("period"),
        )
    )


def period_rejections(internal: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct internal rejections that fall in the period the step was assigned in."""
    keys = [*UNIT, "period"]
    return facts.select(*keys).join(internal.distinct(), keys).distinct()


def rejections_by_worker(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy(*WORKER_KEYS).agg(F.count("image_id").alias("rej_img_count"))


def rejections_by_office(
    rejected: DataFrame, workers: DataFrame, offices: Mapping[str, str]
) -> DataFrame:
    """Rejection counts per period and skill, with one column per (alias, office name)."""
    counted = rejections_by_worker(rejected).join(named_workers(workers), "worker_id")
    total = F.col("rej_img_count")
    return counted.groupBy(*GROUP).agg(
        F.sum(total).alias("rej_img_count"),
        *[
            F.sum(F.when(F.col("office_name") == name, total).otherwise(0)).alias(
                f"rej_img_count_{alias}"
            )
            for alias, name in offices.items()
        ],
    )


def accepted_steps(facts: DataFrame, rejected: DataFrame) -> DataFrame:
    """Steps without an internal rejection for the same image, skill and worker."""
    return facts.join(rejected.select(*UNIT), list(UNIT), "left_anti")


def rejection_units(facts: DataFrame, internal: DataFrame) -> DataFrame:
    """Facts reduced to image, skill, worker and period, with their rejection state.

    ``rejected`` says whether the unit was rejected in its own period, ``ever_rejected``
    whether any period of the same image, skill and worker was. One join and one shuffle of
    the facts give both; a group of the window holds one row per period.
    """
    periods = internal.groupBy(*UNIT).agg(F.collect_set("period").alias("_periods"))
    hit = F.coalesce(F.array_contains("_periods", F.col("period")), F.lit(False))
    units = (
        facts.join(periods, list(UNIT), "left")
        .groupBy(*UNIT, "skill_name", "period")
        .agg(
            F.count(F.lit(1)).alias("img_count"),
            F.count("actual_s").alias("timed"),
            F.sum("actual_s").alias("actual_s"),
            F.sum("expected_ms").alias("expected_ms"),
            F.max(hit).alias("rejected"),
        )
    )
    return units.withColumn("ever_rejected", F.max("rejected").over(W.partitionBy(*UNIT)))


def worker_skill_stats(
    units: DataFrame,
    workers: DataFrame,
    efficiency_digits: int = 5,
    keep_zero_rejections: bool = False,
) -> DataFrame:
    """Accepted work per period, skill and worker with rejection rate and efficiency.

    Workers without any rejection in the period are left out unless asked for. Steps without an
    actual time count as images but not in the mean of the times.
    """
    accepted = ~F.col("ever_rejected")
    work = (
        units.groupBy(*WORKER_KEYS, "skill_name")
        .agg(
            F.sum(F.when(accepted, F.col("img_count"))).alias("img_count"),
            F.sum(F.when(accepted, F.col("timed"))).alias("_timed"),
            F.sum(F.when(accepted, F.col("actual_s"))).alias("sum_actual_s"),
            F.sum(F.when(accepted, F.col("expected_ms"))).alias("sum_expected_ms"),
            F.count(F.when(F.col("rejected"), 1)).alias("rej_img_count"),
        )
        .filter(F.col("img_count") > 0)
    )
    if not keep_zero_rejections:
        work = work.filter(F.col("rej_img_count") > 0)
    images, actual, expected = F.col("img_count"), F.col("sum_actual_s"), F.col("sum_expected_ms")
    rejects = F.col("rej_img_count")
    return work.join(named_workers(workers), "worker_id").select(
        *WORKER_KEYS,
        "skill_name",
        "worker_name",
        "joined_date",
        "office_name",
        N.round_half_up(N.ratio(actual, F.col("_timed")), 2).alias("avg_actual_s"),
        N.round_half_up(N.ratio(expected, images * N.MS_PER_SECOND), 2).alias("avg_expected_s"),
        images,
        actual,
        N.round_half_up(N.ratio(expected, F.lit(N.MS_PER_SECOND)), 2).alias("sum_expected_s"),
        rejects,
        N.round_half_up(N.ratio(rejects, rejects + images), 4).alias("rej_rate"),
        N.round_half_up(N.ratio(actual * N.MS_PER_SECOND, expected), efficiency_digits).alias(
            "efficiency"
        ),
    )


def min_volume(volume: C.MinVolume) -> Column:
    """Minimum image count of ``skill_id`` as a literal map lookup."""
    if not volume.by_skill:
        return F.lit(volume.default)
    return F.expr(f"coalesce({lookup('skill_id', volume.by_skill)}, {volume.default})")


def enough(volume: C.MinVolume) -> Column:
    return F.col("img_count") >= min_volume(volume)


def efficiency_rank(stats: DataFrame, volume: C.MinVolume | None = None) -> DataFrame:
    """RANK by efficiency per skill and period, of all workers or those with enough images."""
    if volume is not None:
        stats = stats.filter(enough(volume))
    ranks = {"efficiency_rank": ("ranked_workers", F.lit(True))}
    return ranking.rank_rows(one_shuffle(stats), GROUP, "efficiency", ranks)


def one_shuffle(stats: DataFrame) -> DataFrame:
    """The same rows, one a worker, skill and period, behind a shuffle on all columns: whatever reads which of
    them, the shuffle is the same and is run once."""
    return stats.distinct()


def expert_quota(ranked: DataFrame, rule: C.MasteryRule) -> DataFrame:
    """Number of experts per skill and period."""
    return (
        ranked.groupBy(*GROUP, "skill_name")
        .agg(F.count("efficiency_rank").alias("ranked_workers"))
        .withColumn("expert_quota", N.share_ceiling(rule.share, F.col("ranked_workers")))
    )


def zone_bounds(ranked: DataFrame, rule: C.MasteryRule) -> DataFrame:
    """Upper bounds of the expert and the mastery zone per skill and period."""
    quota = N.share_ceiling(rule.share, F.col("ranked_workers"))
    rank, value = F.col("efficiency_rank"), F.col("efficiency")
    if rule.bound == "average":
        core = N.mean_of_rounded(F.when(rank <= F.col("expert_quota"), value))
    elif rule.bridge_ties:
        core = F.max(F.when(rank <= F.col("expert_quota"), value))
    else:
        core = F.max(F.when(rank == F.col("expert_quota"), value))
    step = F.lit(rule.mastery_step)
    exact = F.col("_core").cast("decimal(20,10)")
    mastery = exact + step if rule.additive else exact * step
    return (
        ranked.withColumn("expert_quota", quota)
        .groupBy(*GROUP, "skill_name", "expert_quota")
        .agg(core.alias("_core"))
        .select(
            *GROUP,
            "skill_name",
            "expert_quota",
            F.round(exact, rule.bound_digits).cast("double").alias("expert_bound"),
            F.round(mastery, rule.bound_digits).cast("double").alias("mastery_bound"),
        )
    )


def classify_level(
    efficiency: Column, expert: Column, mastery: Column, rule: C.MasteryRule
) -> Column:
    """Level of an efficiency; NULL where the bounds are NULL. Compared as decimals."""
    value, expert, mastery = (c.cast("decimal(20,5)") for c in (efficiency, expert, mastery))
    step = F.lit(rule.premaster_step)
    premaster = mastery + step if rule.additive else expert * step
    first = F.when(value <= expert, "Expert") if rule.with_expert else F
    return (
        first.when(value <= mastery, "Master")
        .when(value <= premaster, "Premaster")
        .when(value > premaster, "Bottom")
    )


def mastery_zones(
    stats: DataFrame, volume: C.MinVolume, rule: C.MasteryRule, office_prefix: str | None = None
) -> DataFrame:
    """All ranked workers with the zone bounds of their skill, distance and level.

    Bounds come from the workers with enough images, levels are given to all.
    """
    ranks = {"efficiency_rank": ("_size", F.lit(True)), "_qualified": ("ranked_workers", enough(volume))}
    everyone = ranking.rank_rows(one_shuffle(stats), GROUP, "efficiency", ranks)
    qualified = everyone.filter(enough(volume)).withColumn("efficiency_rank", F.col("_qualified"))
    bounds = zone_bounds(qualified, rule).drop("skill_name")
    value = F.col("efficiency")
    gap = value.cast("decimal(20,5)") - F.col("mastery_bound").cast("decimal(20,5)")
    zones = everyone.drop("_size", "_qualified", "ranked_workers").join(bounds, list(GROUP))
    if office_prefix is not None:
        zones = zones.filter(F.col("office_name").startswith(office_prefix))
    return zones.withColumn("distance_from_mastery", gap.cast("double")).withColumn(
        "mastery_level",
        classify_level(value, F.col("expert_bound"), F.col("mastery_bound"), rule),
    )
