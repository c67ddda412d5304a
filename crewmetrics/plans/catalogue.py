"""Every report the library is known to be used for, as a name and its parameters.

``run(name, warehouse, as_of, **overrides)`` builds one; overrides replace parameters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.timeops import lookback, pay_window
from crewmetrics.operators import quality as Q
from crewmetrics.operators.trimmed import DateRange
from crewmetrics.plans import reports as R
from crewmetrics.sources import pages


@dataclass(frozen=True)
class Report:
    build: Callable[..., DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    order: tuple[str, ...] = ()


WORKER_ORDER = ("-date", "-shift", "team", "worker_id", "-is_normal", "activity")
OFFICE_ORDER = ("-date", "-shift", "office", "-is_normal", "activity")
TEAM_ORDER = ("-date", "-shift", "office", "team", "-is_normal", "activity")
DAILY_ORDER = ("date", "shift", "worker_id")
MASTERY_ORDER = ("worker_name", "skill_id", "period", "efficiency_rank")
BOUND_ORDER = ("-period", "-efficiency")


def _shift(build, months: int, anchor_day: int = 26, order=WORKER_ORDER, **params) -> Report:
    def make(wh, as_of: dt.date, **kw):
        window = pay_window(as_of, months, months_forward=1, anchor_day=anchor_day)
        return build(wh, kw.pop("window", window), **kw)

    return Report(make, params, order)


def _daily(months: int, days_back: int = 0, **params) -> Report:
    def make(wh, as_of: dt.date, **kw):
        window = pay_window(as_of, months, days_back=days_back)
        return R.report_daily_working_time(wh, kw.pop("window", window), **kw)

    return Report(make, params, DAILY_ORDER)


def _since(build, unit: str, n: int, order=MASTERY_ORDER, **params) -> Report:
    def make(wh, as_of: dt.date, **kw):
        return build(wh, kw.pop("since", lookback(as_of, unit, n)), **kw)

    return Report(make, params, order)


def _fixed(
    build, start: dt.date, end: dt.date, inclusive: bool, order=("-period",), **params
) -> Report:
    def make(wh, as_of: dt.date, **kw):
        return build(wh, kw.pop("dates", DateRange(start, end, inclusive)), **kw)

    return Report(make, params, order)


def _mask(since: dt.datetime) -> Report:
    def make(wh, as_of: dt.date, **kw):
        return Q.mask_quality_rate(
            wh.mask_quality, wh.work_steps, wh.rejections, **{"since": since, **kw}
        )

    return Report(make, order=("date", "grade"))


def _templates(since: dt.datetime, **params) -> Report:
    def make(wh, as_of: dt.date, **kw):
        return Q.template_monthly(wh, kw.pop("since", since), **kw)

    return Report(make, params, ("-month", "-expected_hours"))


WORKER, OFFICE = R.report_worker_shift, R.report_office_shift
day = dt.date
SEMI = {"rollups": C.ROLLUPS_14}
WEEKLY = {"period": "iso_week", "volume": C.WEEKLY_VOLUME}
NEWER = {"skills": C.MASTERY_SKILLS_2021}
V1 = {"rules": C.RULES_V1, "names": C.ACTIVITY_NAMES_V1}

CATALOGUE: dict[str, Report] = {
    # Hours per shift and worker, and per shift and office or team.
    "shift_worker_ipt_post_browser_3mo": _shift(WORKER, 3, codes=(7117,)),
    "shift_worker_breaks_1mo": _shift(WORKER, 1, codes=C.BREAK_IDLE_CODES, **V1),
    "shift_worker_ewt_3mo": _shift(WORKER, 3, codes=C.EWT_CODES),
    "shift_worker_ipt_post_browser_4mo": _shift(
        WORKER, 4, codes=(7117,), names=C.ACTIVITY_NAMES_14, **SEMI
    ),
    "shift_worker_totals_4mo": _shift(
        WORKER,
        4,
        anchor_day=1,
        codes=(1111, 2222),
        rules=C.RULES_V2_14,
        rollups=C.ROLLUPS_PRODUCTION,
        names=C.ACTIVITY_NAMES_PRODUCTION,
        min_end=455,
    ),
    "shift_office_ewt_12mo": _shift(
        OFFICE,
        12,
        order=OFFICE_ORDER,
        codes=(7118,),
        rollups=C.ROLLUPS_EWT,
        names=C.ACTIVITY_NAMES_EWT,
        labels=C.SHIFT_LABELS_NS,
    ),
    "shift_office_all_12mo": _shift(OFFICE, 12, order=OFFICE_ORDER),
    "shift_office_semi_12mo": _shift(
        OFFICE,
        12,
        order=OFFICE_ORDER,
        rules=C.RULES_V2_14,
        names=C.ACTIVITY_NAMES_14_SUMMARY,
        min_end=455,
        **SEMI,
    ),
    "shift_team_1mo": _shift(OFFICE, 1, order=TEAM_ORDER, groups=(2, 4), by_team=True),
    # Daily working time per worker.
    "daily_ewt_2mo": _daily(2),
    "daily_ewt_12mo": _daily(12, days_back=360),
    "daily_ewt_1mo_120_days_back": _daily(1, days_back=120),
    "daily_ewt_1mo_150_days_back": _daily(1, days_back=150),
    "daily_ipt_post_2mo": _daily(2, codes=C.IPT_POST_CODES),
    "daily_post_2mo_60_days_back": _daily(2, days_back=60, codes=C.POST_CODES),
    "daily_all_types_2mo": _daily(2, codes=C.ALL_TIME_CODES),
    # Mastery zones.
    "mastery_month_average_12mo": _since(R.report_mastery_zones, "month", 12, office_prefix="D"),
    "mastery_month_three_levels_4mo": _since(
        R.report_mastery_zones, "month", 4, office_prefix="D", rule=C.AVERAGE_RULE_NO_EXPERT
    ),
    "mastery_week_average_12wk": _since(
        R.report_mastery_zones, "week", 12, office_prefix="D", **WEEKLY
    ),
    "mastery_month_boundary_1mo": _since(
        R.report_mastery_zones, "month", 1, rule=C.BOUNDARY_RULE, **NEWER
    ),
    "mastery_week_boundary_20wk": _since(
        R.report_mastery_zones, "week", 20, rule=C.BOUNDARY_RULE_WEEKLY, **WEEKLY, **NEWER
    ),
    # Trimmed efficiency.
    "trimmed_zone_boundaries": _fixed(
        R.report_zone_boundaries, day(2020, 4, 1), day(2020, 6, 1), False
    ),
    "trimmed_worker_levels": _fixed(
        R.report_worker_levels, day(2020, 11, 1), day(2021, 6, 1), False
    ),
    "trimmed_worker_efficiency": _fixed(
        R.report_worker_efficiency, day(2020, 12, 6), day(2021, 6, 9), True
    ),
    "trimmed_hours_by_worker": _fixed(
        R.report_hours, day(2020, 11, 1), day(2021, 12, 30), True
    ),
    "trimmed_hours_by_office": _fixed(
        R.report_hours,
        day(2020, 1, 1),
        day(2020, 12, 30),
        True,
        by_office=True,
        name_blocks=C.TRIM_NAME_BLOCKS,
    ),
    "trimmed_expert_bounds_month": _fixed(
        R.report_expert_bounds, day(2020, 10, 1), day(2021, 12, 12), False, BOUND_ORDER
    ),
    "trimmed_expert_bounds_week": _fixed(
        R.report_expert_bounds,
        day(2020, 10, 1),
        day(2021, 12, 12),
        False,
        BOUND_ORDER,
        period="year_week",
    ),
    "trimmed_expert_bounds_skill_name": _fixed(
        R.report_expert_bounds,
        day(2020, 10, 1),
        day(2021, 12, 12),
        False,
        BOUND_ORDER,
        period="month_no",
        by_skill_name=True,
        name_blocks=C.TRIM_NAME_BLOCKS,
    ),
    # Customers, templates, masks.
    "template_images_24wk": _since(
        Q.step_performance,
        "week",
        24,
        ("sort_order",),
        template_prefix="Test template",
        by_image=True,
    ),
    "customer_images_24wk": _since(
        Q.step_performance, "week", 24, ("-date",), by_image=True, clock="utc"
    ),
    "customer_rejections_24wk": _since(
        Q.step_performance, "week", 24, ("-date",), clock="local", with_rejections=True
    ),
    "template_monthly": _templates(dt.datetime(2019, 3, 1), template_prefix="Test template"),
    "mask_quality_rate": _mask(dt.datetime(2019, 5, 24)),
}


def run(name: str, wh, as_of: dt.date, **overrides) -> DataFrame:
    report = CATALOGUE[name]
    return report.build(wh, as_of, **{**report.params, **overrides})


def run_page(
    name: str,
    wh,
    as_of: dt.date,
    limit: int = R.PAGE_ROWS,
    offset: int = 0,
    **overrides,
) -> DataFrame:
    """One page of a report in its customary order."""
    return R.page(run(name, wh, as_of, **overrides), CATALOGUE[name].order, limit, offset)


def save_pages(
    name: str,
    wh,
    as_of: dt.date,
    path: str,
    part_rows: int = pages.PART_ROWS,
    slices: int = 1,
    sampled_by: Sequence[str] = (),
    **overrides,
) -> None:
    """Keeps a report in its customary order at the new folder ``path``, for ``pages.read_page``."""
    pages.write_pages(run(name, wh, as_of, **overrides), path, CATALOGUE[name].order, part_rows, slices, sampled_by)


def daily_for_dates(wh, dates: Sequence[dt.date], months: int = 2, days_back: int = 0, **params) -> DataFrame:
    """The daily report of each of ``dates``, in column ``as_of``, from one scan."""
    days = sorted(set(dates))
    found = R.report_daily_for_windows(wh, [pay_window(d, months, days_back=days_back) for d in days], **params)
    named = F.get(F.array(*[F.lit(d) for d in days]), F.col("report"))
    return found.select(named.alias("as_of"), *[c for c in found.columns if c != "report"])
