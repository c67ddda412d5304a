"""Worker dimensions: cohort, office labels, teams, registered shifts, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.text import like_any, like_none, quoted
from crewmetrics.functions.timeops import Window, shift_of_hour


def worker_cohort(
    workers: DataFrame, roles: DataFrame, attributes: Sequence[str] = ()
) -> DataFrame:
    """Producing workers with their group and, if asked, further attributes.

    A worker who holds the freelance role and another producing role keeps one row per
    group, so reports show that worker under both.
    """
    kept = workers.filter(like_none("worker_name", C.COHORT_NAME_BLOCKS, fold="lower")).select(
        "worker_id", "worker_name", "office_id", *attributes
    )
    producing = roles.filter(F.col("role_id").isin(*C.PRODUCING_ROLES))
    bot = F.expr(like_any("worker_name", [("lower", p) for p in C.BOT_NAME_PATTERNS]))
    group = (
        F.when(F.col("role_id") == C.FREELANCE_ROLE, C.FREELANCE_GROUP)
        .when(bot, C.BOT_GROUP)
        .otherwise(F.col("office_id"))
    )
    return (
        kept.join(producing, "worker_id")
        .select("worker_id", "worker_name", group.cast("int").alias("group_id"), *attributes)
        .distinct()
    )


def office_labels(
    offices: DataFrame, prefixes: Sequence[tuple[int, str]] = C.OFFICE_PREFIXES
) -> DataFrame:
    """Label per group: fixed prefix and office name, from either side of a full join."""
    rows = ", ".join(f"({group}, {quoted(prefix)})" for group, prefix in prefixes)
    fixed = offices.sparkSession.sql(f"select * from values {rows} as t(group_id, prefix)")
    named = offices.select(F.col("office_id").alias("group_id"), "office_name")
    label = F.concat(
        F.coalesce(F.col("prefix"), F.lit("")),
        F.coalesce(F.concat(F.lit("_"), F.col("office_name")), F.lit("")),
    )
    return named.join(fixed, "group_id", "full").select("group_id", label.alias("office"))


def team_names(workers: DataFrame, roles: DataFrame) -> DataFrame:
    """First name (alphabetically) among the unlocked team leaders of a planning group."""
    leaders = roles.filter(F.col("role_id") == C.TEAM_LEADER_ROLE).select("worker_id")
    return (
        workers.filter(F.coalesce(F.col("is_locked"), F.lit(0)) == 0)
        .join(leaders, "worker_id")
        .groupBy("planning_group_id")
        .agg(F.min("worker_name").alias("team"))
    )


def registered_shifts(
    reports: DataFrame, workers: DataFrame, window: Window | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Shifts with an end-of-shift report, dated on the local clock, one row per report; ``keep`` names more columns to return."""
    if window is not None:
        reports = window.local_rows(reports, "shift_start_local")
    leaders = workers.select(
        F.col("worker_id").alias("leader_id"), F.col("worker_name").alias("team_shift")
    )
    second_before = F.col("shift_start_local") - F.expr("interval '1' second")
    return (
        reports.withColumn("date", F.to_date("shift_start_local"))
        .withColumn("shift", shift_of_hour(second_before))
        .join(leaders, "leader_id", "left")
        .select("worker_id", "date", "shift", "team_shift", F.lit(1).alias("is_registered"), *keep)
    )


def exclude_workers(
    df: DataFrame, worker_ids: Sequence[int] = C.EXCLUDED_WORKERS
) -> DataFrame:
    """Drops the configured workers. The list is a literal, so it filters at the scan."""
    return df.filter(~F.col("worker_id").isin(*worker_ids)) if worker_ids else df
