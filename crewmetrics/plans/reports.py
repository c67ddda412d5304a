"""Reports: thin compositions of the operators over a warehouse."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions import numeric as N
from crewmetrics.functions.timeops import Segments, Window, day_type, shift_label, with_period_text
from crewmetrics.operators import activity as A
from crewmetrics.operators import mastery as M
from crewmetrics.operators import trimmed as T
from crewmetrics.operators import workforce as P
from crewmetrics.sources.pages import sort_keys

# --- shift and working time ---------------------------------------------------


def _events(wh) -> tuple[DataFrame, DataFrame, DataFrame]:
    return wh.activity_log, wh.logout_requests, wh.meals


def _ids(cohort: DataFrame | None) -> DataFrame | None:
    return None if cohort is None else cohort.select("worker_id")


def shift_hours(
    wh,
    window: Window,
    cohort: DataFrame | None = None,
    rules: C.ActivityRules = C.RULES_V2,
    rollups: Mapping[int, Sequence[int]] = C.ROLLUPS,
    codes: Sequence[int] | None = None,
    min_end: int = 420,
    rollup_gaps: bool = False,
    times: DataFrame | None = None,
) -> DataFrame:
    """Milliseconds per shift, worker and category or roll-up, with the normal-shift flag.

    ``times`` are the window's shift aggregates where they are stored (``operators.incremental``); then no event is read. Only the look-ahead for logout times, which shuffles raw events, is narrowed to ``cohort``; the join of
    the aggregates drops the other workers.
    """
    if times is None:
        durations = codes is None or rollup_gaps or any(c in A.GAP_CODES for c in codes)
        times = A.shift_times(A.timed_events(*_events(wh), rules, window, durations, _ids(cohort)))
    flagged = A.with_normal_flag(times, min_end=min_end)
    rolled = A.rollup_categories(flagged, rollups, ["is_normal"], rollup_gaps)
    return rolled if codes is None else rolled.filter(F.col("code").isin(*codes))


def cohort_of(
    wh,
    groups: Sequence[int] | None,
    excluded: Sequence[int] = (),
    attributes: Sequence[str] = (),
) -> DataFrame:
    """The reported workers, filtered before any join to facts."""
    cohort = P.worker_cohort(P.exclude_workers(wh.workers, excluded), wh.worker_roles, attributes)
    return cohort if groups is None else cohort.filter(F.col("group_id").isin(*groups))


def with_team(cohort: DataFrame, wh) -> DataFrame:
    teams = P.team_names(wh.workers, wh.worker_roles)
    return cohort.join(teams, "planning_group_id", "left").drop("planning_group_id")


def report_worker_shift(
    wh,
    window: Window,
    rules: C.ActivityRules = C.RULES_V2,
    rollups: Mapping[int, Sequence[int]] = C.ROLLUPS,
    names: Mapping[int, str] = C.ACTIVITY_NAMES,
    codes: Sequence[int] | None = None,
    groups: Sequence[int] | None = (4,),
    min_end: int = 420,
    excluded: Sequence[int] = C.EXCLUDED_WORKERS,
    labels: tuple[str, ...] = C.SHIFT_LABELS,
    rollup_gaps: bool = False,
    times: DataFrame | None = None,
) -> DataFrame:
    """Hours per shift, worker and category, with team and shift flags.

    Several end-of-shift reports of one shift repeat its rows.
    """
    cohort = cohort_of(wh, groups, excluded, ["planning_group_id"])
    times = shift_hours(wh, window, cohort if groups else None, rules, rollups, codes, min_end, rollup_gaps, times)
    cohort = with_team(cohort, wh).join(P.office_labels(wh.offices), "group_id", "left")
    registered = P.registered_shifts(wh.shift_reports, wh.workers, window)
    named = A.with_activity_names(times, names, keep_unnamed=codes is None)
    return (
        named.join(cohort, "worker_id")
        .join(registered, ["worker_id", "date", "shift"], "left")
        .select(
            "date",
            shift_label(F.col("shift"), labels).alias("shift"),
            "office",
            "team",
            F.coalesce(F.col("team_shift"), F.lit("")).alias("team_shift"),
            "worker_name",
            "worker_id",
            "is_normal",
            F.coalesce(F.col("is_registered"), F.lit(0)).alias("is_registered"),
            "activity",
            N.hours(F.col("ms")).alias("hours"),
        )
    )


def report_office_shift(
    wh,
    window: Window,
    rules: C.ActivityRules = C.RULES_V2,
    rollups: Mapping[int, Sequence[int]] = C.ROLLUPS,
    names: Mapping[int, str] = C.ACTIVITY_NAMES,
    codes: Sequence[int] | None = None,
    groups: Sequence[int] = (4,),
    min_end: int = 420,
    excluded: Sequence[int] = C.EXCLUDED_WORKERS,
    labels: tuple[str, ...] = C.SHIFT_LABELS,
    by_team: bool = False,
    rollup_gaps: bool = False,
) -> DataFrame:
    """Hours and worker rows per shift, office (and team) and category."""
    cohort = cohort_of(wh, groups, excluded, ["planning_group_id"])
    times = shift_hours(wh, window, cohort if groups else None, rules, rollups, codes, min_end, rollup_gaps)
    team = ["team"] if by_team else []
    if by_team:
        cohort = with_team(cohort, wh)
    summed = (
        times.join(cohort, "worker_id")
        .groupBy("date", "shift", "group_id", *team, "code", "is_normal")
        .agg(F.sum("ms").alias("ms"), F.count("worker_id").alias("worker_rows"))
    )
    named = A.with_activity_names(summed, names, keep_unnamed=codes is None)
    return named.join(P.office_labels(wh.offices), "group_id", "left").select(
        "date",
        shift_label(F.col("shift"), labels).alias("shift"),
        "office",
        *team,
        "is_normal",
        "worker_rows",
        "activity",
        N.hours(F.col("ms")).alias("hours"),
    )


def report_daily_working_time(
    wh,
    window: Window,
    codes: Sequence[int] = C.EWT_CODES,
    groups: Sequence[int] | None = (4,),
    rules: C.ActivityRules = C.RULES_V2,
    holidays: tuple[str, ...] = C.HOLIDAYS,
    substitutes: tuple[str, ...] = C.SUBSTITUTE_DAYS,
) -> DataFrame:
    """Hours of the chosen categories per shift and worker, with day type and report flag."""
    cohort = cohort_of(wh, groups, attributes=["employee_code"])
    if any(c in A.GAP_CODES for c in codes):
        ids = _ids(cohort if groups else None)
        events = A.timed_events(*_events(wh), rules, window, workers=ids)
    else:
        events = A.classify_activity(wh.activity_log, rules, window)
    times = A.working_time(events, codes, by_category=False)
    registered = P.registered_shifts(wh.shift_reports, wh.workers, window)
    return _daily_rows(wh, times, cohort, registered, (), holidays, substitutes)


def report_daily_for_windows(
    wh,
    windows: Sequence[Window],
    codes: Sequence[int] = C.EWT_CODES,
    groups: Sequence[int] | None = (4,),
    rules: C.ActivityRules = C.RULES_V2,
    holidays: tuple[str, ...] = C.HOLIDAYS,
    substitutes: tuple[str, ...] = C.SUBSTITUTE_DAYS,
) -> DataFrame:
    """``report_daily_working_time`` of each of ``windows``, its number in ``report``, from one scan of the events.

    The windows may overlap or leave gaps. Events are summed between the bounds of all windows, and only the sums are
    given to the reports that hold them; time up to a next event beyond a report's end is unknown to that report.
    """
    if not windows:
        raise ValueError("no windows")
    segments = Segments(windows)
    cohort = cohort_of(wh, groups, attributes=["employee_code"])
    hull = segments.hull
    if any(c in A.GAP_CODES for c in codes):
        ids = _ids(cohort if groups else None)
        events = A.timed_events(*_events(wh), rules, hull, workers=ids, keep_next=True)
    else:
        events = A.classify_activity(wh.activity_log, rules, hull).withColumn("next_at", F.lit(None).cast("timestamp_ntz"))
    events = A.with_shift(events.filter(F.col("code").isin(*codes)))
    keys = ["date", "shift", "worker_id"]
    sums = events.groupBy(*keys, segments.of("time_at").alias("segment"), segments.of("next_at").alias("until")).agg(F.sum("runtime_ms").alias("ms"))
    given = sums.withColumn("report", F.explode(segments.reports("segment")))
    known = F.when(F.coalesce(F.col("until") < segments.end_of("report"), F.lit(True)), F.col("ms"))
    times = given.groupBy("report", *keys).agg(F.sum(known).alias("ms"))
    shifts = hull.local_rows(wh.shift_reports, "shift_start_local")
    registered = (
        P.registered_shifts(shifts.withColumn("segment", segments.of("shift_start_local", local=True)), wh.workers, keep=("segment",))
        .withColumn("report", F.explode(segments.reports("segment")))
        .drop("segment")
    )
    return _daily_rows(wh, times, cohort, registered, ("report",), holidays, substitutes)


def _daily_rows(
    wh, times: DataFrame, cohort: DataFrame, registered: DataFrame, more: Sequence[str], holidays: tuple[str, ...], substitutes: tuple[str, ...]
) -> DataFrame:
    """Rows of the daily report; ``more`` are keys that times and registered shifts have beside theirs."""
    cohort = cohort.join(P.office_labels(wh.offices), "group_id", "left")
    return (
        times.join(cohort, "worker_id")
        .join(registered, [*more, "worker_id", "date", "shift"], "left")
        .select(
            *more,
            "date",
            day_type(F.col("date"), holidays, substitutes).alias("day_type"),
            shift_label(F.col("shift")).alias("shift"),
            F.coalesce(F.col("is_registered"), F.lit(0)).alias("is_registered"),
            "worker_id",
            "worker_name",
            "employee_code",
            F.coalesce(F.col("team_shift"), F.lit("")).alias("team"),
            "office",
            N.hours(F.col("ms")).alias("hours"),
        )
    )


# --- mastery ------------------------------------------------------------------


def mastery_inputs(
    wh,
    since: dt.datetime,
    period: str = "month",
    skills: Sequence[int] = C.MASTERY_SKILLS,
) -> tuple[DataFrame, DataFrame]:
    """Step facts and internal rejections."""
    facts = M.step_facts(wh.work_steps, since, skills, period)
    return facts, M.internal_rejections(wh.rejections, since, period)


def mastery_stats(
    wh,
    since: dt.datetime,
    period: str = "month",
    skills: Sequence[int] = C.MASTERY_SKILLS,
    efficiency_digits: int = 5,
    keep_zero_rejections: bool = False,
) -> DataFrame:
    units = M.rejection_units(*mastery_inputs(wh, since, period, skills))
    return M.worker_skill_stats(units, wh.workers, efficiency_digits, keep_zero_rejections)


def report_mastery_zones(
    wh,
    since: dt.datetime,
    period: str = "month",
    rule: C.MasteryRule = C.AVERAGE_RULE,
    volume: C.MinVolume = C.MONTHLY_VOLUME,
    skills: Sequence[int] = C.MASTERY_SKILLS,
    office_prefix: str | None = None,
) -> DataFrame:
    """Workers per skill and period with rank, zone bounds, distance and level."""
    stats = mastery_stats(wh, since, period, skills, rule.efficiency_digits)
    return with_period_text(M.mastery_zones(stats, volume, rule, office_prefix), period)


# --- trimmed efficiency -------------------------------------------------------


def ranked_images(
    wh,
    dates: T.DateRange = T.DateRange(),
    period: str = "month_no",
    name_blocks: Sequence[str] = C.TRIM_NAME_BLOCKS,
) -> DataFrame:
    sole = T.sole_worker_images(wh.work_reports, wh.skills, dates)
    images = T.image_efficiency(sole, wh.work_steps, wh.workers, dates, period, name_blocks)
    return T.rank_images(images)


def ranked_workers(
    wh,
    dates: T.DateRange = T.DateRange(),
    period: str = "month_no",
    name_blocks: Sequence[str] = C.TRIM_NAME_BLOCKS,
) -> DataFrame:
    """Workers numbered by efficiency on the images left after the trim."""
    trimmed = T.trim_by_rank(ranked_images(wh, dates, period, name_blocks))
    return T.worker_efficiency(trimmed)


def _people(wh) -> DataFrame:
    return wh.workers.select("worker_id", "worker_name", "office_name")


def report_zone_boundaries(wh, dates=T.DateRange(), period: str = "month_no") -> DataFrame:
    bounds = T.zone_boundary_values(ranked_workers(wh, dates, period))
    return with_period_text(bounds, period)


def _mean_seconds() -> Column:
    per_image = F.col("image_count") * N.MS_PER_SECOND
    return N.ratio(F.col("sum_actual_ms"), per_image).alias("avg_actual_s")


def report_worker_levels(wh, dates=T.DateRange(), period: str = "month_no") -> DataFrame:
    """Level of every worker by quota, with images and efficiency."""
    levels = T.worker_levels(ranked_workers(wh, dates, period))
    return (
        with_period_text(levels, period)
        .join(_people(wh), "worker_id")
        .select(
            *T.KEYS,
            "worker_id",
            "worker_name",
            "office_name",
            "image_count",
            _mean_seconds(),
            "efficiency",
            "mastery_level",
        )
    )


def report_worker_efficiency(wh, dates=T.DateRange(), period: str = "year_week") -> DataFrame:
    """Images, times and efficiency of every worker."""

    def seconds(ms: str) -> Column:
        return N.ratio(F.col(f"sum_{ms}_ms"), F.lit(N.MS_PER_SECOND)).alias(f"sum_{ms}_s")

    return (
        with_period_text(ranked_workers(wh, dates, period), period)
        .join(_people(wh), "worker_id")
        .select(
            *T.KEYS,
            "worker_id",
            "worker_name",
            "office_name",
            "image_count",
            _mean_seconds(),
            seconds("actual"),
            seconds("expected"),
            "efficiency",
        )
    )


def report_hours(
    wh,
    dates=T.DateRange(),
    period: str = "month",
    by_office: bool = False,
    name_blocks: Sequence[str] = C.TRIM_NAME_BLOCKS_FREE,
) -> DataFrame:
    """Images and hours per skill and worker, or per skill and office."""
    trimmed = T.trim_by_rank(ranked_images(wh, dates, period, name_blocks))
    who = ["office_name"] if by_office else ["worker_id", "worker_name", "office_name"]
    work = trimmed.groupBy(*T.KEYS, "worker_id").agg(
        F.count("image_id").alias("image_count"),
        F.sum("actual_ms").alias("actual_ms"),
        F.sum("expected_ms").alias("expected_ms"),
    )
    total = (
        work.join(_people(wh), "worker_id")
        .groupBy(*T.KEYS, *who)
        .agg(
            F.sum("image_count").alias("image_count"),
            N.round_half_up(N.hours(F.sum("actual_ms")), 2).alias("actual_hours"),
            N.round_half_up(N.hours(F.sum("expected_ms")), 2).alias("expected_hours"),
        )
    )
    return with_period_text(total, period)


def report_expert_bounds(
    wh,
    dates=T.DateRange(),
    period: str = "month",
    by_skill_name: bool = False,
    name_blocks: Sequence[str] = C.TRIM_NAME_BLOCKS_FREE,
) -> DataFrame:
    """Expert bound as average and as boundary value, per skill and period."""
    keys = ("period", "skill_name") if by_skill_name else T.KEYS
    bounds = T.expert_bounds(ranked_workers(wh, dates, period, name_blocks), keys)
    return with_period_text(bounds, period)


# --- paging -------------------------------------------------------------------

PAGE_ROWS = 10_000


def page(
    df: DataFrame, order: Sequence[str], limit: int = PAGE_ROWS, offset: int = 0
) -> DataFrame:
    """One page of a report, ordered by the named columns; ``-name`` sorts downwards.

    NULLs count as the largest value. The other columns break ties, so pages do not overlap. Each page computes and
    sorts the report; ``sources.pages`` keeps a report whose pages are read one after another.
    """
    return df.orderBy(*sort_keys(df.columns, order)).offset(offset).limit(limit)
