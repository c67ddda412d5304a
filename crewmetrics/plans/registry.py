"""Registered queries over the driver tables, and the SQL each is checked against.

Report dates are chosen so that the look-back windows take in the whole tables, except
where a query is about the window itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions import numeric as N
from crewmetrics.functions import timeops as TO
from crewmetrics.operators import activity as A
from crewmetrics.operators import incremental as I
from crewmetrics.operators import mastery as M
from crewmetrics.operators import quality as Q
from crewmetrics.operators import trimmed as T
from crewmetrics.operators import workforce as P
from crewmetrics.plans import catalogue as K
from crewmetrics.plans import oracles as O
from crewmetrics.plans import reports as R
from crewmetrics.session import new_folder, prepare, stored_bytes
from crewmetrics.sources import pages, parts
from crewmetrics.sources.adapters import driver_paths, driver_warehouse
from crewmetrics.sources.oracle_views import with_views

SHIFT_DAY = dt.date(2024, 1, 15)
SHIFT_END = "2024-02-25 23:15:00"
STEP_DAY = dt.date(1995, 1, 10)
SINCE = dt.datetime(1995, 1, 1)
EVERY_DAY = T.DateRange()
# Minimum volumes that suit about a dozen steps per worker, skill and month.
VOLUME = C.MinVolume({121: 3, 5: 4}, 2)
PERIODS = ("month", "month_local", "iso_week", "year_week", "month_no")
OFFICES = {"delta": "Delta Office", "metro": "Metro Office", "dock": "Dock Office"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[..., DataFrame], sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark, *driver_paths(sf_dir))
        return build(driver_warehouse(spark, sf_dir))

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _report(name: str, as_of: dt.date, sql: str | None, **overrides) -> None:
    _add(name, lambda wh: K.run(name, wh, as_of, **overrides), sql)


# --- workforce ----------------------------------------------------------------

_add(
    "worker_cohort",
    lambda wh: P.worker_cohort(wh.workers, wh.worker_roles),
    with_views(f"with {O.COHORT} select * from cohort"),
)
_add(
    "exclude_workers",
    lambda wh: P.exclude_workers(wh.workers),
    with_views(f"select * from workers where worker_id not in {O.EXCLUDED_SQL}"),
)
_add(
    "office_labels",
    lambda wh: P.office_labels(wh.offices)
    .join(
        P.worker_cohort(wh.workers, wh.worker_roles)
        .groupBy("group_id")
        .agg(F.count("worker_id").alias("members")),
        "group_id",
        "left",
    ),
    with_views(f"""with {O.LABELS}, {O.COHORT} select group_id, office, nullif(count(worker_id), 0)
  as members from labels_ left join cohort using (group_id) group by group_id, office"""),
)
_add(
    "team_names",
    lambda wh: P.team_names(wh.workers, wh.worker_roles),
    with_views(f"with {O.TEAMS} select * from teams"),
)
_add(
    "registered_shifts",
    lambda wh: P.registered_shifts(wh.shift_reports, wh.workers),
    with_views(f"with {O.registered()} select * from registered"),
)

# --- activity -----------------------------------------------------------------

for _name, _rules, _sql in (
    ("classify_activity_v1", C.RULES_V1, O.classifier(1)),
    ("classify_activity_v2", C.RULES_V2, O.classifier(2)),
    ("classify_activity_v2_semi", C.RULES_V2_14, O.classifier(2, semi=True)),
):
    _add(
        _name,
        lambda wh, rules=_rules: A.classify_activity(wh.activity_log, rules),
        with_views(f"with {O.activity(_sql)} select * from act"),
    )

_ACT = O.activity(O.classifier())
_ACT_SEMI = O.activity(O.classifier(semi=True))
_SHIFTED = f"{_ACT}, {O.timed({})}"

_add(
    "activity_dictionary_join",
    lambda wh: A.with_activity_names(
        A.classify_activity(wh.activity_log, C.RULES_V2), C.ACTIVITY_NAMES
    ),
    with_views(
        f"with {_ACT}, {O.names_table(O.NAMES)} "
        "select * from act left join names_ using (code)"
    ),
)
_add(
    "logout_gaps",
    lambda wh: A.logout_gaps(wh.activity_log, wh.logout_requests),
    with_views(f"with {_ACT}, {O.gaps()} select * from gaps"),
)
_add(
    "meal_time",
    lambda wh: A.meal_time(wh.meals),
    with_views(f"with {O.meals()} select * from meal"),
)


def _times(wh) -> DataFrame:
    return A.shift_times(A.timed_events(wh.activity_log, wh.logout_requests, wh.meals))


_add(
    "working_time_by_shift",
    lambda wh: A.working_time(A.timed_events(wh.activity_log, wh.logout_requests, wh.meals)),
    with_views(
        f"with {_SHIFTED} select date, shift, worker_id, code, cast(sum(runtime_ms) as bigint) as ms "
        "from shifted group by all"
    ),
)
_add(
    "working_time_total",
    lambda wh: A.working_time(
        A.classify_activity(wh.activity_log), C.EWT_CODES, by_category=False
    ),
    with_views(
        f"with {_SHIFTED} select date, shift, worker_id, cast(sum(runtime_ms) as bigint) as ms "
        "from shifted where code in (110, 7, 10, 5, 9) group by all"
    ),
)
_add(
    "rollup_categories",
    lambda wh: A.rollup_categories(
        A.shift_times(
            A.timed_events(wh.activity_log, wh.logout_requests, wh.meals, C.RULES_V2_14)
        ),
        C.ROLLUPS_PRODUCTION,
    ),
    with_views(
        f"with {_ACT_SEMI}, {O.timed(O.ROLLUPS_PRODUCTION)} select date, shift, worker_id, code, "
        "cast(sum(runtime_ms) as bigint) as ms from shifted group by all"
    ),
)
for _end in (420, 455):
    _add(
        f"normal_shifts_{_end}",
        lambda wh, end=_end: A.normal_shifts(_times(wh), min_end=end),
        with_views(f"with {_SHIFTED}, {O.normal(_end)} select * from normal"),
    )
_add(
    "day_type",
    lambda wh: wh.activity_log.select(F.to_date("time_at").alias("date"))
    .groupBy("date")
    .agg(F.count(F.lit(1)).alias("events"))
    .withColumn("day_type", TO.day_type(F.col("date"), ("2024-01-01", "2024-01-28"), ("2024-01-02",))),
    with_views("""
select cast(time_at as date) as date, count(*) as events,
  case when cast(time_at as date) in (date '2024-01-01', date '2024-01-28') then '3_Holiday'
    when cast(time_at as date) = date '2024-01-02' or dayofweek(cast(time_at as date)) = 0
    then '2_Weekend' else '1_Weekday' end as day_type
from activity_log group by 1, 3"""),
)

# --- windows and labels -------------------------------------------------------

_add(
    "pay_window_filter",
    lambda wh: wh.activity_log.filter(
        TO.pay_window(dt.date(2024, 1, 31), 1, days_back=10).utc("time_at")
    ),
    with_views(
        "select * from activity_log where time_at >= timestamp '2023-12-25 23:15:00' "
        "and time_at < timestamp '2024-01-25 23:15:00'"
    ),
)
_add(
    "lookback_filter",
    lambda wh: wh.rejections.filter(
        TO.local_since("rejected_at", TO.lookback(dt.date(1998, 7, 20), "month", 12))
    ),
    with_views(
        "select * from rejections "
        "where rejected_at + interval '7' hour >= timestamp '1997-07-01'"
    ),
)
_add(
    "date_range_filter",
    lambda wh: wh.mask_quality.filter(
        TO.date_range("created_at", dt.date(1996, 3, 1), dt.date(1999, 3, 1), inclusive=True)
    ),
    with_views(
        "select * from mask_quality where created_at >= timestamp '1996-03-01' "
        "and created_at <= timestamp '1999-03-01'"
    ),
)
_add(
    "period_labels",
    lambda wh: wh.work_steps.groupBy(
        *[TO.period_number(F.col("assign_at"), kind).alias(kind) for kind in PERIODS]
    )
    .agg(F.count(F.lit(1)).alias("steps"))
    .select(*[TO.period_text(F.col(kind), kind).alias(kind) for kind in PERIODS], "steps"),
    with_views(f"""
select {O.month('assign_at')} as month,
  strftime(assign_at + interval '7' hour, '%Y-%m') as month_local,
  {O.iso_week('assign_at')} as iso_week, {O.year_week('assign_at')} as year_week,
  {O.month_no('assign_at')} as month_no, count(*) as steps
from steps group by all"""),
)

# --- mastery ------------------------------------------------------------------

_B = O.mastery_ctes()


def _facts(wh):
    facts, internal = R.mastery_inputs(wh, SINCE)
    return facts, M.period_rejections(internal, facts)


def _labelled(df: DataFrame) -> DataFrame:
    return TO.with_period_text(df, "month")


_add(
    "skill_steps",
    lambda wh: _labelled(M.skill_steps(_facts(wh)[0], wh.workers)),
    with_views(f"with {_B} select * from facts"),
)


def _named_rejections(wh) -> DataFrame:
    _, rejected = _facts(wh)
    office = M.named_workers(wh.workers).select("worker_id", "office_name")
    return rejected.join(office, "worker_id")


_add("period_rejections", lambda wh: _labelled(_named_rejections(wh)), with_views(f"with {_B} select * from rejected"))
_add(
    "rejections_by_worker",
    lambda wh: _labelled(M.rejections_by_worker(_named_rejections(wh))),
    with_views(f"with {_B} select period, skill_id, worker_id, rej_img_count from rej_counts"),
)
_add(
    "rejections_by_office",
    lambda wh: _labelled(M.rejections_by_office(_facts(wh)[1], wh.workers, OFFICES)),
    with_views(f"""with {_B} select period, skill_id, count(image_id) as rej_img_count,
  count(case when office_name = 'Delta Office' then image_id end) as rej_img_count_delta,
  count(case when office_name = 'Metro Office' then image_id end) as rej_img_count_metro,
  count(case when office_name = 'Dock Office' then image_id end) as rej_img_count_dock
from rejected group by all"""),
)
_add(
    "accepted_steps",
    lambda wh: _labelled(M.skill_steps(M.accepted_steps(*_facts(wh)), wh.workers)),
    with_views(f"with {_B} select * from accepted"),
)
_add(
    "worker_skill_stats",
    lambda wh: _labelled(R.mastery_stats(wh, SINCE)),
    with_views(f"with {_B} select * from stats"),
)
_add(
    "worker_skill_stats_all_workers",
    lambda wh: _labelled(R.mastery_stats(wh, SINCE, keep_zero_rejections=True)),
    with_views(f"with {O.mastery_ctes(join='left join')} select * from stats"),
)
_add(
    "efficiency_rank",
    lambda wh: _labelled(M.efficiency_rank(R.mastery_stats(wh, SINCE)).drop("ranked_workers")),
    with_views(f"with {_B} select * from everyone"),
)
_add(
    "efficiency_rank_min_volume",
    lambda wh: _labelled(M.efficiency_rank(R.mastery_stats(wh, SINCE), VOLUME)),
    with_views(f"with {_B} select * from ranked"),
)
_add(
    "expert_quota",
    lambda wh: _labelled(M.expert_quota(
        M.efficiency_rank(R.mastery_stats(wh, SINCE), VOLUME), C.AVERAGE_RULE
    )),
    with_views(f"with {_B} select * from quota"),
)
_add(
    "zone_bounds_average",
    lambda wh: _labelled(M.zone_bounds(
        M.efficiency_rank(R.mastery_stats(wh, SINCE), VOLUME), C.AVERAGE_RULE
    )),
    with_views(f"with {_B} {O.bounds_select('average')}"),
)
_add(
    "zone_bounds_boundary",
    lambda wh: _labelled(M.zone_bounds(
        M.efficiency_rank(R.mastery_stats(wh, SINCE, efficiency_digits=4), VOLUME),
        C.BOUNDARY_RULE,
    )),
    with_views(f"with {O.mastery_ctes(digits=4)} {O.bounds_select('boundary')}"),
)

_WEEK = {"label": O.iso_week}
_report("mastery_month_average_12mo", STEP_DAY, O.zones("average", since="1994-01-01", office="D"), volume=VOLUME)
_report(
    "mastery_month_three_levels_4mo",
    STEP_DAY,
    O.zones("average", since="1994-09-01", with_expert=False, office="D"),
    volume=VOLUME,
)
_report(
    "mastery_week_average_12wk",
    STEP_DAY,
    O.zones("average", since="1994-10-17", office="D", **_WEEK),
    volume=VOLUME,
)
_report(
    "mastery_month_boundary_1mo",
    STEP_DAY,
    O.zones("boundary", since="1994-12-01", digits=4),
    volume=VOLUME,
)
_report(
    "mastery_week_boundary_20wk",
    STEP_DAY,
    O.zones("boundary", since="1994-08-22", **_WEEK),
    volume=VOLUME,
)

# --- trimmed efficiency -------------------------------------------------------

_add(
    "sole_worker_images",
    lambda wh: T.sole_worker_images(wh.work_reports, wh.skills),
    O.trimmed("select * from sole"),
)
_add(
    "image_efficiency_rank",
    lambda wh: R.ranked_images(wh),
    O.trimmed("select * from ranked_images"),
)
_add(
    "trimmed_images",
    lambda wh: _labelled(T.trim_by_rank(R.ranked_images(wh, period="month"))),
    O.trimmed("select * from trimmed", O.month),
)
_add(
    "trimmed_images_symmetric",
    lambda wh: T.trim_by_rank(R.ranked_images(wh), symmetric=True).drop("outliers"),
    O.trimmed("""select * from ranked_images where image_rank > round(0.05 * image_count, 0)
  and image_rank <= image_count - round(0.05 * image_count, 0)"""),
)
_add(
    "worker_efficiency",
    lambda wh: _labelled(R.ranked_workers(wh, period="month")),
    O.trimmed("select * from ranked_workers", O.month),
)
_add(
    "level_quotas",
    lambda wh: _labelled(T.level_quotas(R.ranked_workers(wh, period="month"))),
    O.trimmed("select * from quotas", O.month),
)
_FREE = {"free": True}
_report("trimmed_zone_boundaries", STEP_DAY, O.trimmed(O.ZONE_BOUNDARIES), dates=EVERY_DAY)
_report("trimmed_worker_levels", STEP_DAY, O.trimmed(O.WORKER_LEVELS), dates=EVERY_DAY)
_report(
    "trimmed_worker_efficiency", STEP_DAY, O.trimmed(O.WORKER_LIST, O.year_week), dates=EVERY_DAY
)
_report(
    "trimmed_hours_by_worker",
    STEP_DAY,
    O.trimmed(O.hours_by("worker_id, worker_name, office_name"), O.month, **_FREE),
    dates=EVERY_DAY,
)
_report(
    "trimmed_hours_by_office",
    STEP_DAY,
    O.trimmed(O.hours_by("office_name"), O.month),
    dates=EVERY_DAY,
)
_IDS = "r.period, r.skill_id, skill_name"
_report(
    "trimmed_expert_bounds_month",
    STEP_DAY,
    O.trimmed(O.expert_bounds(_IDS), O.month, **_FREE),
    dates=EVERY_DAY,
)
_report(
    "trimmed_expert_bounds_week",
    STEP_DAY,
    O.trimmed(O.expert_bounds(_IDS), O.year_week, **_FREE),
    dates=EVERY_DAY,
)
_report(
    "trimmed_expert_bounds_skill_name",
    STEP_DAY,
    O.trimmed(O.expert_bounds("r.period, skill_name")),
    dates=EVERY_DAY,
)

# --- shift reports ------------------------------------------------------------

_SEMI_RULE = O.classifier(2, semi=True)
_report(
    "shift_worker_ipt_post_browser_3mo",
    SHIFT_DAY,
    O.worker_shift("2023-10-25 23:15:00", SHIFT_END, (7117,)),
)
_report(
    "shift_worker_breaks_1mo",
    SHIFT_DAY,
    O.worker_shift(
        "2023-12-25 23:15:00", SHIFT_END, (1, -1, 1013), O.classifier(1), names=O.NAMES_V1
    ),
)
_report(
    "shift_worker_ewt_3mo",
    SHIFT_DAY,
    O.worker_shift("2023-10-25 23:15:00", SHIFT_END, O.EWT_CODES),
)
_report(
    "shift_worker_ipt_post_browser_4mo",
    SHIFT_DAY,
    O.worker_shift(
        "2023-09-25 23:15:00",
        SHIFT_END,
        (7117,),
        rollups=O.ROLLUPS_14,
        names=O.NAMES_14,
    ),
)
_report(
    "shift_worker_totals_4mo",
    SHIFT_DAY,
    O.worker_shift(
        "2023-08-31 23:15:00",
        "2024-01-31 23:15:00",
        (1111, 2222),
        _SEMI_RULE,
        O.ROLLUPS_PRODUCTION,
        O.NAMES_PRODUCTION,
        455,
    ),
)
_report(
    "shift_office_ewt_12mo",
    SHIFT_DAY,
    O.office_shift(
        "2023-01-25 23:15:00",
        SHIFT_END,
        (7118,),
        rollups=O.ROLLUPS_EWT,
        names=O.NAMES_EWT,
        labels=O.SHIFT_LABELS_NS,
    ),
)
_report("shift_office_all_12mo", SHIFT_DAY, O.office_shift("2023-01-25 23:15:00", SHIFT_END))
_report(
    "shift_office_semi_12mo",
    SHIFT_DAY,
    O.office_shift(
        "2023-01-25 23:15:00",
        SHIFT_END,
        rule=_SEMI_RULE,
        rollups=O.ROLLUPS_14,
        names=O.NAMES_14_SUMMARY,
        min_end=455,
    ),
)
_report(
    "shift_team_1mo",
    SHIFT_DAY,
    O.office_shift("2023-12-25 23:15:00", SHIFT_END, group="(2, 4)", by_team=True),
)
# The same detail report for every group: freelancers, bots and all offices.
_add(
    "shift_worker_all_groups",
    lambda wh: K.run("shift_worker_ewt_3mo", wh, SHIFT_DAY, groups=None, codes=None),
    O.worker_shift("2023-10-25 23:15:00", SHIFT_END, group="(2, 3, 4, 5, 8, 998, 999)"),
)

_report(
    "daily_ewt_2mo", dt.date(2024, 2, 10), O.daily("2023-12-25 23:15:00", SHIFT_END, O.EWT_CODES)
)
_report(
    "daily_ewt_12mo", dt.date(2025, 2, 4), O.daily("2023-02-25 23:15:00", SHIFT_END, O.EWT_CODES)
)
_JANUARY = ("2023-12-25 23:15:00", "2024-01-25 23:15:00")


def daily_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily report over a log and shift reports laid out by day: only days of its window are opened."""
    prepare(spark, *driver_paths(sf_dir))
    wh, folder = driver_warehouse(spark, sf_dir), new_folder(spark, "days")
    laid = {}
    for name in ("activity_log", "shift_reports"):
        parts.write_days(getattr(wh, name), f"{folder}/{name}", parts.DAY_OF[name])
        laid[name] = parts.read_days(spark, name, f"{folder}/{name}")
    return K.run("daily_ewt_2mo", wh.replaced(**laid), dt.date(2024, 1, 10))


def daily_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily report kept as a table by day: two months written, then one month of them run again."""
    prepare(spark, *driver_paths(sf_dir))
    wh, path = driver_warehouse(spark, sf_dir), new_folder(spark, "daily")
    whole = K.run("daily_ewt_2mo", wh, dt.date(2024, 2, 10))
    parts.replace_parts(whole, path, "date")
    window = TO.Window(*(dt.datetime.fromisoformat(t) for t in _JANUARY))
    days = [dt.date(2023, 12, 26) + dt.timedelta(days=n) for n in range(31)]
    parts.replace_parts(K.run("daily_ewt_2mo", wh, dt.date(2024, 2, 10), window=window), path, "date", days)
    return parts.read_parts(spark, path, whole.schema)


QUERIES["daily_ewt_over_days"] = daily_over_days
ORACLES["daily_ewt_over_days"] = O.daily("2023-11-25 23:15:00", "2024-01-25 23:15:00", O.EWT_CODES)
QUERIES["daily_ewt_saved"] = daily_saved
ORACLES["daily_ewt_saved"] = O.daily("2023-12-25 23:15:00", SHIFT_END, O.EWT_CODES)


def shift_worker_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift report of every group from stored days: a month without half of its logouts, the rest, then that month's late rows."""
    prepare(spark, *driver_paths(sf_dir))
    wh, path = driver_warehouse(spark, sf_dir), new_folder(spark, "shift-days")
    whole = TO.Window(dt.datetime(2023, 10, 25, 23, 15), dt.datetime.fromisoformat(SHIFT_END))
    first, second = (TO.Window(*(dt.datetime.fromisoformat(t) for t in ends)) for ends in (_JANUARY, (_JANUARY[1], SHIFT_END)))
    early = wh.replaced(logout_requests=wh.logout_requests.where("event_id % 2 = 0"))
    I.write_days(early, path, first)
    I.write_days(wh, path, second)
    I.write_days(wh, path, first)
    times = I.read_times(spark, path, whole)
    return K.run("shift_worker_ewt_3mo", wh, SHIFT_DAY, groups=None, codes=None, times=times)


QUERIES["shift_worker_from_days"] = shift_worker_from_days
# Before the two months written the tables have no events.
ORACLES["shift_worker_from_days"] = O.worker_shift(_JANUARY[0], SHIFT_END, group="(2, 3, 4, 5, 8, 998, 999)")

# Twelve report dates, one scan.
_MONTHS = [(2023, m) for m in (10, 11, 12)] + [(2024, m) for m in range(1, 10)]


def _each_month(codes) -> str:
    def anchor(year: int, month: int) -> str:
        return f"{year - (month < 1)}-{(month - 1) % 12 + 1:02}-25 23:15:00"

    return " union all ".join(
        f"select date '{y}-{m:02}-10' as as_of, * from ({O.daily(anchor(y, m - 2), anchor(y, m), codes)})" for y, m in _MONTHS
    )


for _name, _codes in (("daily_ewt_each_month", C.EWT_CODES), ("daily_all_types_each_month", C.ALL_TIME_CODES)):
    _add(
        _name,
        lambda wh, codes=_codes: K.daily_for_dates(wh, [dt.date(y, m, 10) for y, m in _MONTHS], codes=codes),
        _each_month(_codes),
    )
_report(
    "daily_ewt_1mo_120_days_back", dt.date(2024, 5, 9), O.daily(*_JANUARY, O.EWT_CODES)
)
_report(
    "daily_ewt_1mo_150_days_back", dt.date(2024, 6, 8), O.daily(*_JANUARY, O.EWT_CODES)
)
_report(
    "daily_ipt_post_2mo",
    dt.date(2024, 2, 10),
    O.daily("2023-12-25 23:15:00", SHIFT_END, (110, 10)),
)
_report(
    "daily_post_2mo_60_days_back",
    dt.date(2024, 4, 10),
    O.daily("2023-12-25 23:15:00", SHIFT_END, (10,)),
)
_report(
    "daily_all_types_2mo",
    dt.date(2024, 2, 10),
    O.daily("2023-12-25 23:15:00", SHIFT_END, O.ALL_TIME_CODES),
)

# --- windows that cut -----------------------------------------------------------
# The same reports with a bound inside the data, so that a wrong clock or bound shows.

_add(
    "mastery_month_average_cut",
    lambda wh: K.run("mastery_month_average_12mo", wh, dt.date(1998, 3, 10), volume=VOLUME),
    O.zones("average", since="1997-03-01", office="D"),
)
_add(
    "mastery_week_boundary_cut",
    lambda wh: K.run("mastery_week_boundary_20wk", wh, dt.date(1998, 7, 1), volume=VOLUME),
    O.zones("boundary", since="1998-02-09", **_WEEK),
)
_CUT_START = "2024-01-25 23:15:00"
_add(
    "shift_worker_ewt_cut",
    lambda wh: K.run("shift_worker_ewt_3mo", wh, dt.date(2024, 4, 15)),
    O.worker_shift(_CUT_START, "2024-05-25 23:15:00", O.EWT_CODES),
)
_add(
    "shift_worker_all_cut",
    lambda wh: K.run("shift_worker_ewt_3mo", wh, dt.date(2024, 4, 15), groups=None, codes=None),
    O.worker_shift(_CUT_START, "2024-05-25 23:15:00", group="(2, 3, 4, 5, 8, 998, 999)"),
)
_add(
    "daily_all_types_cut",
    lambda wh: K.run("daily_all_types_2mo", wh, dt.date(2024, 3, 10)),
    O.daily(_CUT_START, "2024-03-25 23:15:00", O.ALL_TIME_CODES),
)

# --- customers, templates, masks ----------------------------------------------

_report("template_images_24wk", STEP_DAY, O.performance(by_image=True), template_prefix="Template")
_report("customer_images_24wk", STEP_DAY, O.performance(by_image=True, clock="utc"))
_report(
    "customer_rejections_24wk", STEP_DAY, O.performance(clock="local", rejected="fan_out")
)
_add(
    "customer_images_cut",
    lambda wh: K.run("customer_images_24wk", wh, dt.date(1998, 6, 10)),
    O.performance(by_image=True, clock="utc", since="1997-12-22"),
)
_add(
    "customer_images_one",
    lambda wh: K.run("customer_images_24wk", wh, STEP_DAY, customer_id=7),
    O.performance(by_image=True, clock="utc", only="s.customer_id = 7"),
)
_add(
    "customer_rejections_one_skill",
    lambda wh: K.run("customer_rejections_24wk", wh, STEP_DAY, skill="LARGE"),
    O.performance(clock="local", rejected="fan_out", only="k.skill_name = 'LARGE'"),
)
_add(
    "customer_rejections_single_count",
    lambda wh: K.run("customer_rejections_24wk", wh, STEP_DAY, fan_out=False),
    O.performance(clock="local", rejected="single"),
)
_add(
    "step_performance",
    lambda wh: Q.step_performance(wh, SINCE),
    O.performance(),
)
_report(
    "template_monthly", STEP_DAY, O.TEMPLATE_MONTHLY, since=SINCE, template_prefix="Template"
)
_report("mask_quality_rate", STEP_DAY, O.mask_rate("join"), since=SINCE)
_add(
    "mask_quality_rate_all_images",
    lambda wh: K.run("mask_quality_rate", wh, STEP_DAY, since=SINCE, rejected_only=False),
    O.mask_rate("left join"),
)
_add(
    "latest_per_group",
    lambda wh: Q.latest_grades(wh.mask_quality, "Good", SINCE),
    with_views(
        f"with {O.MASK_CTES} select distinct l.image_id, l.created_at from latest l "
        "join mask_quality m on m.image_id = l.image_id and m.created_at = l.created_at "
        "where grade = 'Good'"
    ),
)

# --- paging and top-k ---------------------------------------------------------

#: Bytes of stored input for each slice of a report that is kept in order.
SLICE_BYTES = 1 << 30

_add(
    "page_two",
    lambda wh: K.run_page("shift_worker_ewt_3mo", wh, SHIFT_DAY, limit=150, offset=150),
    O.paged(
        O.worker_shift("2023-10-25 23:15:00", SHIFT_END, O.EWT_CODES),
        "date desc, shift desc, team, worker_id, is_normal desc, activity, office, team_shift, "
        "worker_name, is_registered, hours",
        150,
        150,
    ),
)


def page_far_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 4,000 to 5,000 of the images by customer, from the report kept in order."""
    prepare(spark, *driver_paths(sf_dir))
    path = f"{new_folder(spark, 'pages')}/customer_images"
    slices = -(-stored_bytes(spark, *driver_paths(sf_dir)) // SLICE_BYTES)
    K.save_pages(
        "customer_images_24wk", driver_warehouse(spark, sf_dir), STEP_DAY, path, part_rows=500, slices=slices, sampled_by=["image_id"]
    )
    return pages.read_page(spark, path, 1000, 4000)


QUERIES["page_far_in"] = page_far_in
ORACLES["page_far_in"] = O.paged(
    O.performance(by_image=True, clock="utc"),
    "date desc, date_time, skill_name, worker_name, email, employee_code, office_name, image_id, template_name, template_id, "
    "company, customer_id, skill_id, sort_order, img_count, avg_actual_s, avg_expected_s, efficiency, sum_actual_s, sum_expected_s",
    1000,
    4000,
)
_add(
    "mastery_first_page",
    lambda wh: K.run_page(
        "mastery_month_boundary_1mo", wh, STEP_DAY, limit=1000, volume=VOLUME
    ),
    O.paged(
        O.zones("boundary", since="1994-12-01", digits=4),
        "worker_name, skill_id, period, efficiency_rank, worker_id",
        1000,
    ),
)
_add(
    "top_rows",
    lambda wh: K.run_page("mask_quality_rate", wh, STEP_DAY, limit=300, since=SINCE),
    O.mask_rate("join") + " order by 1, 2 limit 300",
)
_add(
    "working_hours_by_office",
    lambda wh: A.working_time(A.classify_activity(wh.activity_log))
    .join(wh.workers.select("worker_id", "office_name"), "worker_id")
    .groupBy("date", "shift", "office_name")
    .agg(N.hours(F.sum("ms")).alias("hours"), F.count(F.lit(1)).alias("worker_rows")),
    with_views(
        f"with {_ACT}, t as (select cast(time_at + interval '45' minute as date) as date, "
        "cast(extract(hour from time_at + interval '45' minute) // 8 as int) as shift, worker_id, "
        "code, sum(runtime_ms) as ms from act group by all) select date, shift, office_name, "
        "cast(cast(sum(ms) as bigint) as double) / 3600000 as hours, count(*) as worker_rows "
        "from t join workers using (worker_id) group by date, shift, office_name"
    ),
)
