"""Activity time: classification, logout and meal gaps, shift aggregates, roll-ups, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.text import in_list, like_any, lookup
from crewmetrics.functions.timeops import Window, millis_between, minutes_between, with_shift

SHIFT_KEYS = ("date", "shift", "worker_id")
GAP_CODES = (C.MEAL, C.LOGOUT)


# --- classification -----------------------------------------------------------


def activity_code(rules: C.ActivityRules) -> Column:
    """First matching rule of the classifier as one CASE expression.

    A row without a code fails the guard: NULL <> 12 is unknown, not true.
    """
    guard = f"activity_type_id <> {C.MEAL_SOURCE_CODE} and " if rules.guard_meal_code else ""
    branches = [
        f"when coalesce(image_id, 0) > 0 and (login_type_id = 0 or activity_type_id = 0) "
        f"then {C.IMAGE_PROCESSING}",
        f"when {in_list('activity_type_id', rules.direct_codes)} then activity_type_id",
        *[
            f"when {guard}{like_any('application_name', patterns)} then {category}"
            for category, patterns in rules.app_rules
        ],
    ]
    if rules.guard_meal_code:
        branches.append(
            f"when activity_type_id = {C.MEAL_SOURCE_CODE} then {C.MEAL_REFERENCE}"
        )
    return F.expr(f"cast(case {' '.join(branches)} else {rules.default} end as int)")


def classify_activity(
    log: DataFrame, rules: C.ActivityRules = C.RULES_V2, window: Window | None = None
) -> DataFrame:
    """Log events of the window with their category code."""
    if window is not None:
        log = window.utc_rows(log, "time_at")
    return log.select(
        "event_id", "worker_id", activity_code(rules).alias("code"), "runtime_ms", "time_at"
    )


def with_activity_names(df: DataFrame, names: Mapping[int, str], keep_unnamed: bool = True) -> DataFrame:
    """Adds the display name of a code from the fixed dictionary."""
    named = df.withColumn("activity", F.expr(lookup("code", names)))
    return named if keep_unnamed else named.filter(F.col("activity").isNotNull())


# --- gaps ---------------------------------------------------------------------


def _counted_logouts(logouts: DataFrame) -> DataFrame:
    return logouts.filter(
        F.col("reason_id").isNotNull() & (F.col("reason_id") != C.REASON_END_SHIFT)
    )


def _gap_code() -> Column:
    return F.when(F.col("reason_id") == C.REASON_MEAL, C.MEAL).otherwise(C.LOGOUT).cast("int")


def logout_gaps(
    log: DataFrame,
    logouts: DataFrame,
    window: Window | None = None,
    slice_seconds: int = 3600,
    keep_next: bool = False,
) -> DataFrame:
    """Time from a logout to the worker's next event of either kind.

    The next event is looked up per worker and time slice, so one busy worker is spread over
    many tasks. Only a logout that ends its slice has to look further: for it, the first
    events of all slices of the worker are enough, at most two rows per slice. The worker's
    last event in the window has no successor and keeps a NULL duration. ``keep_next`` adds the next event's
    time as ``next_at``.
    """
    if window is not None:
        log = window.utc_rows(log, "time_at")
        logouts = window.utc_rows(logouts, "requested_at")
    events = log.select(
        "worker_id",
        "time_at",
        F.lit(0).alias("kind"),
        "event_id",
        F.lit(None).cast("int").alias("reason_id"),
    ).unionByName(
        logouts.select(
            "worker_id",
            F.col("requested_at").alias("time_at"),
            F.lit(1).alias("kind"),
            "event_id",
            F.col("reason_id").cast("int").alias("reason_id"),
        )
    )
    seconds = F.unix_seconds(F.col("time_at").cast("timestamp"))
    order = ["time_at", "kind", "event_id"]
    in_slice = W.partitionBy("worker_id", "slice").orderBy(*order)
    first, last = F.col("before").isNull(), F.col("after").isNull()
    counted = F.col("reason_id").isNotNull() & (F.col("reason_id") != C.REASON_END_SHIFT)
    near = (
        events.withColumn("slice", F.floor(seconds / F.lit(slice_seconds)))
        .withColumn("before", F.lag("kind").over(in_slice))
        .withColumn("after", F.lead("time_at").over(in_slice))
        .filter(first | counted)
        .withColumn("edge", first | last)
    )
    # Edges of all slices of a worker together; the other logouts stay in their slice.
    ahead = W.partitionBy("worker_id", F.when(~F.col("edge"), F.col("slice"))).orderBy(*order)
    return (
        near.withColumn("next_at", F.coalesce("after", F.lead("time_at").over(ahead)))
        .filter(counted)
        .select(
            "event_id",
            "worker_id",
            _gap_code().alias("code"),
            millis_between(F.col("time_at"), F.col("next_at")).alias("runtime_ms"),
            "time_at",
            *(["next_at"] if keep_next else []),
        )
    )


def logout_marks(logouts: DataFrame, window: Window | None = None) -> DataFrame:
    """The same rows as ``logout_gaps`` without durations, for reports that only need times."""
    if window is not None:
        logouts = window.utc_rows(logouts, "requested_at")
    return _counted_logouts(logouts).select(
        "event_id",
        "worker_id",
        _gap_code().alias("code"),
        F.lit(None).cast("long").alias("runtime_ms"),
        F.col("requested_at").alias("time_at"),
    )


def meal_time(meals: DataFrame, window: Window | None = None) -> DataFrame:
    """Recorded meals, dated at their start."""
    if window is not None:
        meals = window.utc_rows(meals, "start_at")
    return meals.select(
        "event_id",
        "worker_id",
        F.lit(C.MEAL).alias("code"),
        millis_between(F.col("start_at"), F.col("finish_at")).alias("runtime_ms"),
        F.col("start_at").alias("time_at"),
    )


# --- shift aggregates ---------------------------------------------------------


def timed_events(
    log: DataFrame,
    logouts: DataFrame,
    meals: DataFrame,
    rules: C.ActivityRules = C.RULES_V2,
    window: Window | None = None,
    gap_durations: bool = True,
    workers: DataFrame | None = None,
    keep_next: bool = False,
) -> DataFrame:
    """Classified log events, logout gaps and meals as one relation.

    ``keep_next`` adds the time of the event after a logout as ``next_at``, NULL for all that doesn't depend on one.

    ``workers`` (worker_id) narrows what looks for the event after a logout to the workers asked
    for; their events are the same with and without it, those of others lose their logouts.
    """
    if not gap_durations:
        gaps = logout_marks(logouts, window)
    elif workers is None:
        gaps = logout_gaps(log, logouts, window, keep_next=keep_next)
    else:
        gaps = logout_gaps(
            log.join(workers, "worker_id", "left_semi"),
            logouts.join(workers, "worker_id", "left_semi"),
            window,
            keep_next=keep_next,
        )
    return (
        classify_activity(log, rules, window)
        .unionByName(gaps, allowMissingColumns=keep_next)
        .unionByName(meal_time(meals, window), allowMissingColumns=keep_next)
    )


def shift_times(events: DataFrame) -> DataFrame:
    """Time, first and last event per production date, shift, worker and code.

    The only aggregate over raw events: sums, first and last times come out of one partial
    aggregation and one shuffle.
    """
    return (
        with_shift(events)
        .groupBy(*SHIFT_KEYS, "code")
        .agg(
            F.sum("runtime_ms").alias("ms"),
            F.min("shift_clock").alias("first_at"),
            F.max("shift_clock").alias("last_at"),
        )
    )


def rollup_codes(rollups: Mapping[int, Sequence[int]], with_gaps: bool) -> Column:
    """Array of the code itself and the roll-up codes it counts towards."""
    members = [
        f"case when {in_list('code', [m for m in listed if with_gaps or m not in GAP_CODES])} "
        f"then {target} end"
        for target, listed in rollups.items()
    ]
    return F.expr(f"array_compact(array({', '.join(['code', *members])}))")


def rollup_categories(
    times: DataFrame,
    rollups: Mapping[int, Sequence[int]],
    extra_keys: Sequence[str] = (),
    with_gaps: bool = False,
) -> DataFrame:
    """Adds roll-up rows to shift aggregates.

    Meal and logout gaps never enter a roll-up unless ``with_gaps`` is set, even where a
    roll-up lists their codes. Fanning out the aggregate keeps the raw events single.
    """
    keys = [*SHIFT_KEYS, *extra_keys]
    fanned = times.withColumn("code", F.explode(rollup_codes(rollups, with_gaps)))
    return fanned.groupBy(*keys, "code").agg(F.sum("ms").alias("ms"))


def working_time(
    events: DataFrame, codes: Sequence[int] | None = None, by_category: bool = True
) -> DataFrame:
    """Milliseconds per production date, shift, worker and, if asked, category."""
    if codes is not None:
        events = events.filter(F.col("code").isin(*codes))
    keys = [*SHIFT_KEYS, "code"] if by_category else [*SHIFT_KEYS]
    return with_shift(events).groupBy(*keys).agg(F.sum("runtime_ms").alias("ms"))


def _is_normal(first: Column, last: Column, max_start_gap: int, min_end: int) -> Column:
    start = F.expr(f"cast(date as timestamp_ntz) + shift * interval '{C.SHIFT_HOURS}' hour")
    return (minutes_between(start, first) < max_start_gap) & (minutes_between(start, last) > min_end)


def with_normal_flag(times: DataFrame, max_start_gap: int = 60, min_end: int = 420) -> DataFrame:
    """Flags the rows of a worker's shift as normal from its first and last event.

    A group holds one row per category of one worker's shift.
    """
    shift = W.partitionBy(*SHIFT_KEYS)
    normal = _is_normal(
        F.min("first_at").over(shift), F.max("last_at").over(shift), max_start_gap, min_end
    )
    return times.withColumn("is_normal", F.when(normal, 1).otherwise(0).cast("int"))


def normal_shifts(times: DataFrame, max_start_gap: int = 60, min_end: int = 420) -> DataFrame:
    """Shifts begun early and ended late enough, with their first and last event."""
    return (
        times.groupBy(*SHIFT_KEYS)
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        .filter(_is_normal(F.col("first_at"), F.col("last_at"), max_start_gap, min_end))
    )
