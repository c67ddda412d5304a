"""DuckDB SQL of the registered queries, written in the plain shape of the reports.

Ranks are windows over whole groups and joins fan out here; the Spark side gets the same
rows without them.
"""

from __future__ import annotations

from crewmetrics.sources.oracle_views import with_views

# Fixed values, written out here once more so that a slip in the engine's tables shows.
ROLLUPS = {7116: (110, 10), 7117: (110, 10, 5)}
ROLLUPS_EWT = {7116: (110, 10), 7117: (110, 10, 5), 7118: (110, 7, 10, 5, 9)}
ROLLUPS_14 = {7116: (110, 10, 14), 7117: (110, 10, 14, 5)}
ROLLUPS_PRODUCTION = {
    7116: (110, 10, 14),
    7117: (110, 10, 14, 5),
    1111: (1, 411, 1312, 514, 310, 1001, 1091, 1092),
    2222: (110, 7, 10, 14, 6, 5, 9),
}
EWT_CODES = (110, 7, 10, 5, 9)
ALL_TIME_CODES = (110, 1, 7, 411, 1312, -1, 514, 10, 310, 1001, 1013, 6, 5, 9, 8, 1091, 1092)
SHIFT_LABELS_NS = ("1_AM", "2_PM", "3_NS")
NAMES = {
    110: "1_IPT",
    1: "2_Break",
    7: "3_NoAssignedImage",
    411: "4_Others_",
    1312: "5_Browser_",
    -1: "6_IDLE",
    514: "7_Skype_",
    10: "1__PostProcessingTime",
    2: "9_TrainingMeetingTime",
    3: "9_TrainingMeetingTime",
    4: "9_TrainingMeetingTime",
    310: "a_Explorer_",
    1001: "b_WorkingTool_",
    1013: "b_IDLE_",
    6: "d_NoDownloadedImage",
    5: "e_WorkingOnBrowser",
    9: "f_WaitForDownloading",
    8: "g_SystemErrorTime",
    1091: "l_HaveMeal",
    1093: "l_ref_HaveMeal",
    1092: "l_Logout",
    7116: "1__IPTAndPostProcessing",
    7117: "1__IPTAndPostProcessingWorkOnBrowser",
}
NAMES_EWT = NAMES | {7118: "1__EWT"}
NAMES_V1 = {code: name for code, name in NAMES.items() if code != 1093}
NAMES_14 = NAMES | {10: "1__FullAutoPostProcessingTime", 14: "1__SemiAutoPostProcessingTime"}
NAMES_14_SUMMARY = NAMES_14 | {14: "1__SemiPostProcessingTime"}
NAMES_PRODUCTION = NAMES | {
    10: "1__PostProcessingTime_full",
    14: "1__PostProcessingTime_semi",
    1111: "ProductionTime",
    2222: "Non_ProductionTime",
}


def _in(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def _rnd(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,12)), {digits}) as double)"


def _ratio(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


# --- shift and working time ---------------------------------------------------

EXCLUDED_SQL = """(1634, 1645, 2113, 1644, 982, 2023, 1637, 980, 1639, 1890, 2736, 1649, 1027,
 1640, 1031, 2307, 2191, 1922, 1808, 2192, 1831, 1939, 1443, 1925, 3258, 3644, 4201)"""

_TOOLS = """upper(application_name) like '%PHOTO EDITOR CLIENT%'
 or upper(application_name) like 'PHOTOEDITORCLIENT%' or upper(application_name) like '%CALC%'
 or application_name in ('Photoshop', 'Lightshot', 'Notepad', 'Snipping Tool', 'Sticky Notes',
   '7-Zip GUI', 'WinRAR', 'Microsoft Excel')
 or application_name like 'Adobe Photoshop C%' or application_name like 'Notepad++%'
 or application_name like 'Adobe Bridge CC%' or lower(application_name) like '%stemain.exe%'
 or lower(application_name) in ('stemain', 'ste', 'ste launcher')
 or lower(application_name) like '%smooth_path%'"""
_CHROME = """upper(application_name) like 'CHROME%'
 or upper(application_name) like 'GOOGLE CHROME%'"""
_BROWSERS = """upper(application_name) like 'COCCOC%' or upper(application_name) like 'COC COC%'
 or upper(application_name) like 'INTERNET EXPLORER%'
 or upper(application_name) like '%FIREFOX%'
 or application_name in ('UC Browser', 'Opera Internet Browser')
 or upper(application_name) like 'BROWSER%'"""


def classifier(version: int = 2, semi: bool = False) -> str:
    direct = "7, 1, 9, 10, 14, 6, 5, 2, 3, 4, -1, 8" if semi else "7, 1, 9, 10, 6, 5, 2, 3, 4, -1, 8"
    guard = "activity_type_id <> 12 and " if version == 2 else ""
    tools = f"{_TOOLS} or {_CHROME}" if version == 2 else _TOOLS
    more = "upper(application_name) like '%BRAVE%'" if version == 2 else _CHROME
    last = "when activity_type_id = 12 then 1093" if version == 2 else ""
    return f"""case when coalesce(image_id, 0) > 0 and (login_type_id = 0 or activity_type_id = 0)
        then 110
      when activity_type_id in ({direct}) then activity_type_id
      when {guard}({tools}) then 1001
      when {guard}upper(application_name) like '%SKYPE%' then 514
      when {guard}upper(application_name) like 'IDLE%' then 1013
      when {guard}upper(application_name) like '%EXPLORER%' then 310
      when {guard}({_BROWSERS} or {more}) then 1312 {last} else 411 end"""


COHORT = """cohort as (
  select distinct w.worker_id, worker_name,
    case when role_id = 8 then 999
      when lower(worker_name) like 'auto%' or lower(worker_name) like '% bot %' then 998
      else office_id end as group_id
  from workers w join worker_roles r on r.worker_id = w.worker_id and role_id in (3, 8, 33)
    and lower(worker_name) not like '%demo%' and lower(worker_name) not like '%test%'
    and lower(worker_name) not like '%dev%')"""

LABELS = """labels_ as (
  select coalesce(p.group_id, o.office_id) as group_id,
    coalesce(prefix, '') || coalesce('_' || office_name, '') as office
  from (values (2, '1'), (3, '3'), (4, '2'), (8, '4'), (990, '2_Site Two Partner Worker'),
    (996, '1_Site One Partner Team'), (998, '6_AutoBot'), (999, '5_Freelancer')) p(group_id, prefix)
  full join offices o on p.group_id = o.office_id)"""

TEAMS = """teams as (
  select planning_group_id, min(worker_name) as team
  from workers w join worker_roles r on r.worker_id = w.worker_id and role_id = 9
  where coalesce(is_locked, 0) = 0 group by planning_group_id)"""


def _window(ts: str, start: str | None, end: str | None) -> str:
    return f"where {ts} >= timestamp '{start}' and {ts} < timestamp '{end}'" if start else ""


def activity(rule: str, start: str | None = None, end: str | None = None) -> str:
    return f"""act as (
  select event_id, worker_id, {rule} as code, runtime_ms, time_at
  from activity_log {_window('time_at', start, end)})"""


def gaps(start: str | None = None, end: str | None = None) -> str:
    return f"""ordered_ as (
  select *, lead(time_at) over (partition by worker_id order by time_at, kind, event_id) as next_at
  from (select event_id, worker_id, time_at, 0 as kind, null as reason_id from act
        union all select event_id, worker_id, requested_at, 1, reason_id
        from logout_requests {_window('requested_at', start, end)})),
gaps as (
  select event_id, worker_id, case when reason_id = 7 then 1091 else 1092 end as code,
    date_diff('millisecond', time_at, next_at) as runtime_ms, time_at
  from ordered_ where kind = 1 and reason_id is not null and reason_id <> 6)"""


def meals(start: str | None = None, end: str | None = None) -> str:
    return f"""meal as (
  select event_id, worker_id, 1091 as code,
    date_diff('millisecond', start_at, finish_at) as runtime_ms, start_at as time_at
  from meals {_window('start_at', start, end)})"""


def timed(rollups: dict, start: str | None = None, end: str | None = None) -> str:
    rolled = "".join(
        f"\n  union all select worker_id, {code}, runtime_ms, time_at from act where code in {_in(m)}"
        for code, m in rollups.items()
    )
    return f"""{gaps(start, end)}, {meals(start, end)},
timed as (
  select worker_id, code, runtime_ms, time_at + interval '45' minute as clock from (
  select worker_id, code, runtime_ms, time_at from act
  union all select worker_id, code, runtime_ms, time_at from gaps
  union all select worker_id, code, runtime_ms, time_at from meal{rolled})),
shifted as (
  select *, cast(clock as date) as date, cast(extract(hour from clock) // 8 as int) as shift
  from timed)"""


def normal(min_end: int) -> str:
    return f"""normal as (
  select date, shift, worker_id, min(clock) as first_at, max(clock) as last_at
  from shifted group by date, shift, worker_id
  having date_diff('minute', cast(date as timestamp) + shift * 8 * interval '1' hour, min(clock)) < 60
    and date_diff('minute', cast(date as timestamp) + shift * 8 * interval '1' hour, max(clock))
      > {min_end})"""


def registered(start: str | None = None, end: str | None = None) -> str:
    local = "shift_start_local - interval '7' hour"
    return f"""registered as (
  select s.worker_id, cast(shift_start_local as date) as date,
    cast(extract(hour from shift_start_local - interval '1' second) // 8 as int) as shift,
    w.worker_name as team_shift, 1 as is_registered
  from shift_reports s left join workers w on w.worker_id = s.leader_id
  {_window(local, start, end)})"""


def names_table(names: dict) -> str:
    rows = ", ".join(f"({c}, '{n}')" for c, n in names.items())
    return f"names_ as (select * from (values {rows}) t(code, activity))"


def shift_name(labels=("1_AM", "2_PM", "3_NI")) -> str:
    a, b, c = labels
    return f"case shift when 0 then '{a}' when 1 then '{b}' when 2 then '{c}' end"


def worker_shift(
    start: str,
    end: str,
    codes=None,
    rule: str | None = None,
    rollups: dict = ROLLUPS,
    names: dict = NAMES,
    min_end: int = 420,
    group: str = "(4)",
) -> str:
    wanted = f"and t.code in {_in(codes)}" if codes else ""
    return with_views(f"""
with {activity(rule or classifier(), start, end)}, {timed(rollups, start, end)}, {normal(min_end)},
{registered(start, end)}, {COHORT}, {LABELS}, {TEAMS}, {names_table(names)},
timing as (select date, shift, worker_id, code, cast(sum(runtime_ms) as bigint) as ms
  from shifted group by date, shift, worker_id, code)
select t.date, {shift_name()} as shift, office, team, coalesce(team_shift, '') as team_shift,
  w.worker_name, t.worker_id, case when n.worker_id is null then 0 else 1 end as is_normal,
  coalesce(is_registered, 0) as is_registered, activity, cast(ms as double) / 3600000 as hours
from timing t join cohort c on c.worker_id = t.worker_id
  left join workers w on w.worker_id = t.worker_id
  left join teams using (planning_group_id) left join names_ using (code)
  left join labels_ l on l.group_id = c.group_id
  left join registered r on r.date = t.date and r.shift = t.shift and r.worker_id = t.worker_id
  left join normal n on n.date = t.date and n.shift = t.shift and n.worker_id = t.worker_id
where c.group_id in {group} and t.worker_id not in {EXCLUDED_SQL} {wanted}""").replace(
        "case shift ", "case t.shift "
    )


def office_shift(
    start: str,
    end: str,
    codes=None,
    rule: str | None = None,
    rollups: dict = ROLLUPS,
    names: dict = NAMES,
    min_end: int = 420,
    group: str = "(4)",
    by_team: bool = False,
    labels=("1_AM", "2_PM", "3_NI"),
) -> str:
    wanted = f"and code in {_in(codes)}" if codes else ""
    team = "team, " if by_team else ""
    return with_views(f"""
with {activity(rule or classifier(), start, end)}, {timed(rollups, start, end)}, {normal(min_end)},
{COHORT}, {LABELS}, {TEAMS}, {names_table(names)},
timing as (select date, shift, worker_id, code, cast(sum(runtime_ms) as bigint) as ms
  from shifted group by date, shift, worker_id, code),
ps as (
  select t.date, t.shift, c.group_id, {team} t.code,
    case when n.worker_id is null then 0 else 1 end as is_normal,
    cast(sum(ms) as bigint) as ms, count(c.worker_id) as worker_rows
  from timing t join cohort c on c.worker_id = t.worker_id
    left join workers w on w.worker_id = t.worker_id
    left join teams using (planning_group_id)
    left join normal n on n.date = t.date and n.shift = t.shift and n.worker_id = t.worker_id
  where t.worker_id not in {EXCLUDED_SQL}
  group by all)
select date, {shift_name(labels)} as shift, office, {team} is_normal, worker_rows, activity,
  cast(ms as double) / 3600000 as hours
from ps left join names_ using (code) left join labels_ using (group_id)
where group_id in {group} {wanted}""")


def daily(start: str, end: str, codes, group: str = "(4)") -> str:
    return with_views(f"""
with {activity(classifier(), start, end)}, {timed(ROLLUPS, start, end)}, {registered(start, end)},
{COHORT}, {LABELS},
timing as (select date, shift, worker_id, cast(sum(runtime_ms) as bigint) as ms
  from shifted where code in {_in(codes)} group by date, shift, worker_id)
select t.date,
  case when t.date in (date '2019-01-01', date '2019-04-14', date '2019-04-30', date '2019-05-01')
      then '3_Holiday' when t.date = date '2019-04-15' then '2_Weekend'
    when dayofweek(t.date) = 0 then '2_Weekend' else '1_Weekday' end as day_type,
  {shift_name()} as shift, case when r.shift is null then 0 else 1 end as is_registered,
  t.worker_id, w.worker_name, w.employee_code, coalesce(team_shift, '') as team, office,
  cast(ms as double) / 3600000 as hours
from timing t join cohort c on c.worker_id = t.worker_id
  left join workers w on w.worker_id = t.worker_id
  left join labels_ l on l.group_id = c.group_id
  left join registered r on r.date = t.date and r.shift = t.shift and r.worker_id = t.worker_id
where c.group_id in {group}""").replace("case shift ", "case t.shift ")


# --- mastery ------------------------------------------------------------------

NOT_BLOCKED = " and ".join(
    f"worker_name not like '{p}'"
    for p in ("Freel%", "Auto%", "auto%", "%demo%", "% Bot %", "%test%", "%dev%")
)
WHITELIST = """(121, 5, 43, 479, 44, 160, 9, 22, 29, 10, 6, 65, 40, 46, 16, 13, 14, 3, 8, 74, 75,
 521, 128, 120, 70, 303, 47, 1, 434, 328, 23, 12, 133, 131, 11, 430, 313, 167, 304, 168, 15, 39,
 21, 333, 20, 26, 444, 145, 435, 452, 455, 330, 461, 326, 490, 491, 198, 135, 337, 458, 480, 488,
 484, 486, 426, 438, 439)"""


def month(ts: str) -> str:
    return f"strftime({ts} + interval '7' hour, '%Y') || '-' || strftime({ts}, '%m')"


def iso_week(ts: str) -> str:
    return f"strftime({ts} + interval '7' hour, '%G-W%V')"


def year_week(ts: str) -> str:
    return f"strftime({ts} + interval '7' hour, '%Y') || '-' || strftime({ts}, '%V')"


def month_no(ts: str) -> str:
    return f"cast(extract(month from {ts}) as int)"


def mastery_ctes(label=month, since: str = "1995-01-01", digits: int = 5, join: str = "join") -> str:
    return f"""facts as (
  select image_id, skill_id, worker_id, skill_name, {label('assign_at')} as period, actual_s,
    expected_ms, worker_name, joined_date, office_name
  from steps join workers using (worker_id)
  where assign_at + interval '7' hour >= timestamp '{since}' and expected_ms > 0
    and skill_id in {WHITELIST} and {NOT_BLOCKED}),
rejected as (
  select distinct r.image_id, r.skill_id, r.receiver_id as worker_id, f.period, f.office_name
  from rejections r join facts f on f.skill_id = r.skill_id and f.image_id = r.image_id
    and f.worker_id = r.receiver_id and f.period = {label('rejected_at')}
  where rejected_at >= timestamp '{since}' and coalesce(is_customer, 0) = 0),
rej_counts as (
  select period, worker_id, skill_id, office_name, count(image_id) as rej_img_count
  from rejected group by all),
accepted as (
  select f.* from facts f left join (select distinct image_id, skill_id, worker_id from rejected) r
    on r.image_id = f.image_id and r.skill_id = f.skill_id and r.worker_id = f.worker_id
  where r.image_id is null),
stats as (
  select a.period, a.skill_id, a.worker_id, skill_name, worker_name, joined_date, a.office_name,
    {_rnd('avg(actual_s)', 2)} as avg_actual_s,
    {_rnd(_ratio('sum(expected_ms)', '(count(*) * 1000)'), 2)} as avg_expected_s,
    count(image_id) as img_count, cast(sum(actual_s) as bigint) as sum_actual_s,
    {_rnd(_ratio('sum(expected_ms)', '1000'), 2)} as sum_expected_s,
    coalesce(rej_img_count, 0) as rej_img_count,
    {_rnd(_ratio('coalesce(rej_img_count, 0)', '(coalesce(rej_img_count, 0) + count(image_id))'), 4)}
      as rej_rate,
    {_rnd(_ratio('(sum(actual_s) * 1000)', 'sum(expected_ms)'), digits)} as efficiency
  from accepted a {join} rej_counts c on c.period = a.period and c.worker_id = a.worker_id
    and c.skill_id = a.skill_id
  group by a.period, a.skill_id, a.worker_id, skill_name, worker_name, joined_date,
    a.office_name, rej_img_count),
everyone as (
  select *, rank() over (partition by skill_id, period order by efficiency nulls last) as efficiency_rank
  from stats),
ranked as (
  select *, rank() over (partition by skill_id, period order by efficiency nulls last) as efficiency_rank,
    count(*) over (partition by skill_id, period) as ranked_workers
  from stats where img_count >= case skill_id when 121 then 3 when 5 then 4 else 2 end),
quota as (
  select period, skill_id, skill_name, count(*) as ranked_workers,
    cast(ceil(0.10 * count(*)) as bigint) as expert_quota
  from ranked group by all),
bounds_avg as (
  select r.period, r.skill_id, r.skill_name, expert_quota,
    cast(cast(sum(case when efficiency_rank <= expert_quota
        then cast(efficiency as decimal(20,5)) end) as double)
      / count(case when efficiency_rank <= expert_quota then 1 end) as decimal(20,10)) as core
  from ranked r join quota using (period, skill_id) group by all),
bounds_rank as (
  select r.period, r.skill_id, r.skill_name, expert_quota,
    cast(max(case when efficiency_rank = expert_quota then efficiency end) as decimal(20,10)) as core
  from ranked r join quota using (period, skill_id) group by all)"""


def bounds_select(rule: str) -> str:
    if rule == "average":
        return """select period, skill_id, skill_name, expert_quota,
  cast(round(core, 2) as double) as expert_bound,
  cast(round(core + 0.3, 2) as double) as mastery_bound from bounds_avg"""
    return """select period, skill_id, skill_name, expert_quota,
  cast(round(core, 4) as double) as expert_bound,
  cast(round(cast(core as decimal(24,10)) * 1.3, 4) as double) as mastery_bound from bounds_rank"""


def zones(
    rule: str,
    label=month,
    since: str = "1995-01-01",
    digits: int = 5,
    with_expert: bool = True,
    office: str | None = None,
) -> str:
    expert = "when e <= x then 'Expert'" if with_expert else ""
    top = "m + 0.2" if rule == "average" else "x * 1.5"
    where = f"where office_name like '{office}%'" if office else ""
    return with_views(f"""
with {mastery_ctes(label, since, digits)}, bounds as ({bounds_select(rule)}),
joined as (
  select e.*, b.expert_quota, b.expert_bound, b.mastery_bound,
    cast(efficiency as decimal(20,5)) as e, cast(expert_bound as decimal(20,5)) as x,
    cast(mastery_bound as decimal(20,5)) as m
  from everyone e join bounds b on b.period = e.period and b.skill_id = e.skill_id)
select * exclude (e, x, m), cast(e - m as double) as distance_from_mastery,
  case {expert} when e <= m then 'Master' when e <= {top} then 'Premaster'
    when e > {top} then 'Bottom' end as mastery_level
from joined {where}""")


# --- trimmed efficiency -------------------------------------------------------


def trimmed_ctes(label=month_no, free: bool = False) -> str:
    blocks = "worker_name not like '%bot%'" + (
        " and worker_name not like '%Free%'" if free else ""
    )
    return f"""sole as (
  select image_id, skill_id, min(worker_id) as worker_id
  from work_reports join skills using (skill_id)
  where skill_kind_id = 0 and status_id = 10
  group by image_id, skill_id having count(distinct worker_id) = 1),
images_ as (
  select {label('assign_at')} as period, s.skill_id, s.skill_name, s.worker_id, s.image_id, line_no,
    part_id, assign_at, actual_ms, expected_ms,
    cast(actual_ms as double) / cast(expected_ms as double) as efficiency
  from sole o join steps s on o.image_id = s.image_id and o.skill_id = s.skill_id
    and o.worker_id = s.worker_id and actual_ms > 0 and expected_ms > 0
    join workers w on w.worker_id = s.worker_id and {blocks}),
ranked_images as (
  select *, row_number() over (partition by skill_id, period order by efficiency, image_id, line_no,
      part_id, worker_id, assign_at, actual_ms, expected_ms) as image_rank,
    count(image_id) over (partition by skill_id, period) as image_count
  from images_),
trimmed as (
  select *, cast(round(0.05 * image_count, 0) as bigint) as outliers from ranked_images
  where image_rank > round(0.05 * image_count, 0)
    and image_rank < image_count - round(0.05 * image_count, 0)),
work as (
  select period, skill_id, skill_name, worker_id, count(image_id) as image_count,
    cast(sum(actual_ms) as bigint) as sum_actual_ms,
    cast(sum(expected_ms) as bigint) as sum_expected_ms,
    {_ratio('sum(actual_ms)', 'sum(expected_ms)')} as efficiency
  from trimmed group by period, skill_id, skill_name, worker_id),
ranked_workers as (
  select *, row_number() over (partition by skill_id, period order by efficiency, worker_id)
      as worker_rank, count(*) over (partition by skill_id, period) as worker_count
  from work),
quotas as (
  select period, skill_id, skill_name, count(worker_id) as worker_count,
    cast(round(0.25 * count(worker_id), 0) as bigint) as masters,
    cast(round(0.50 * count(worker_id), 0) as bigint) as premasters,
    cast(count(worker_id) - round(0.25 * count(worker_id), 0) - round(0.50 * count(worker_id), 0)
      as bigint) as bottoms
  from work group by period, skill_id, skill_name),
expert_n as (
  select period, skill_id, cast(round(0.1 * count(worker_id), 0) as bigint) as expert_quota
  from work group by period, skill_id)"""


def trimmed(select: str, label=month_no, free: bool = False) -> str:
    return with_views(f"with {trimmed_ctes(label, free)}\n{select}")


PEOPLE_RANKED = "ranked_workers r join workers w on w.worker_id = r.worker_id"
AVG_SECONDS = _ratio("r.sum_actual_ms", "(r.image_count * 1000)")

ZONE_BOUNDARIES = """select q.period, q.skill_id, q.skill_name, q.worker_count, masters, premasters,
  bottoms, sum(case when worker_rank = masters then efficiency end) as mastery_zone,
  sum(case when worker_rank = premasters then efficiency end) as premastery_zone
from quotas q join ranked_workers r on r.skill_id = q.skill_id and r.period = q.period
  and (worker_rank = masters or worker_rank = premasters)
group by all"""

WORKER_LEVELS = f"""select r.period, r.skill_id, r.skill_name, r.worker_id, worker_name, office_name,
  r.image_count, {AVG_SECONDS} as avg_actual_s, efficiency,
  case when worker_rank <= masters then 'Master'
    when worker_rank <= masters + premasters then 'Pre-Master' else 'Bottom' end as mastery_level
from {PEOPLE_RANKED} join quotas q on q.skill_id = r.skill_id and q.period = r.period"""

WORKER_LIST = f"""select r.period, r.skill_id, r.skill_name, r.worker_id, worker_name, office_name,
  r.image_count, {AVG_SECONDS} as avg_actual_s, {_ratio('r.sum_actual_ms', '1000')} as sum_actual_s,
  {_ratio('r.sum_expected_ms', '1000')} as sum_expected_s, efficiency
from {PEOPLE_RANKED}"""


def hours_by(who: str) -> str:
    return f"""select period, skill_id, skill_name, {who},
  cast(sum(image_count) as bigint) as image_count,
  {_rnd(_ratio('sum(sum_actual_ms)', '3600000'), 2)} as actual_hours,
  {_rnd(_ratio('sum(sum_expected_ms)', '3600000'), 2)} as expected_hours
from work r join workers w using (worker_id) group by all"""


def expert_bounds(keys: str) -> str:
    def mean(cond: str) -> str:
        value = f"sum(case when {cond} then cast(efficiency as decimal(28,12)) end)"
        return _rnd(_ratio(value, f"count(case when {cond} then 1 end)"), 2)

    return f"""select {keys}, expert_quota,
  {_ratio('sum(sum_actual_ms)', 'sum(sum_expected_ms)')} as efficiency,
  {mean('worker_rank <= expert_quota')} as expert_bound_avg,
  {mean('worker_rank = expert_quota')} as expert_bound_rank
from ranked_workers r join expert_n n on n.period = r.period and n.skill_id = r.skill_id
group by {keys}, expert_quota"""


# --- customers, templates, masks ----------------------------------------------


def performance(
    by_image: bool = False,
    clock: str | None = None,
    rejected: str | None = None,
    since: str | None = None,
    only: str | None = None,
) -> str:
    at = {"utc": "s.assign_at", "local": "s.assign_at + interval '7' hour"}.get(clock)
    times = [f"cast({at} as date) as date", f"{at} as date_time"] if at else []
    cols = [
        *times,
        "k.skill_name",
        "worker_name",
        "email",
        "employee_code",
        "office_name",
        *(["s.image_id"] if by_image else []),
        "t.template_name",
        "t.template_id",
        "company",
        "s.customer_id",
        "s.skill_id",
        "sort_order",
    ]
    join, count = "", ""
    more = f"and s.assign_at + interval '7' hour > timestamp '{since}'" if since else ""
    more += f" and {only}" if only else ""
    if rejected == "fan_out":
        join = "left join rejections r on r.skill_id = s.skill_id and r.image_id = s.image_id"
        count = ", count(r.image_id) as rej_count"
    if rejected == "single":
        # One row per image and report key carries the rejections of its image and skill.
        join = """left join (select image_id, skill_id, count(*) as n from rejections group by all) r
  on r.skill_id = s.skill_id and r.image_id = s.image_id"""
        per = "image_id, skill_id, worker_id, customer_id, template_name"
        count = f""", cast(sum(case when s.first_of_key then coalesce(n, 0) else 0 end) as bigint)
  as rej_count"""
        source = f"""(select *, row_number() over (partition by {per}
    {', assign_at' if at else ''} order by line_no, part_id, actual_ms, expected_ms) = 1 as first_of_key
  from steps) s"""
    else:
        source = "steps s"
    return with_views(f"""
select {', '.join(cols)}, count(distinct s.image_id) as img_count,
  {_rnd(_ratio('sum(actual_ms)', '(count(s.image_id) * 1000)'), 1)} as avg_actual_s,
  {_rnd(_ratio('sum(expected_ms)', '(count(s.image_id) * 1000)'), 1)} as avg_expected_s,
  {_rnd(_ratio('sum(actual_ms)', 'sum(expected_ms)'), 2)} as efficiency,
  {_rnd(_ratio('sum(actual_ms)', '1000'), 1)} as sum_actual_s,
  {_rnd(_ratio('sum(expected_ms)', '1000'), 1)} as sum_expected_s{count}
from {source} join workers w on w.worker_id = s.worker_id
  join skills k on k.skill_id = s.skill_id join images i on i.image_id = s.image_id
  join templates t on t.template_name = s.template_name and t.customer_id = s.customer_id
    and t.is_deleted <> 1
  join customers c on c.customer_id = s.customer_id {join}
where k.skill_name not like 'QA G%' and worker_name not like 'auto%' {more}
group by all""")


TEMPLATE_MONTHLY = with_views(f"""
with kept as (
  select cast(extract(month from assign_at + interval '7' hour) as int) as month, s.skill_id,
    skill_name, s.image_id, actual_ms, expected_ms
  from steps s join images i on i.image_id = s.image_id join workers w on w.worker_id = s.worker_id
  where skill_name not like 'QA %' and worker_name not like 'auto%'
    and worker_name not like 'Auto%' and worker_name not like '%bot%'
    and template_name like 'Template%' and expected_ms > 0),
internal as (
  select cast(extract(month from rejected_at) as int) as month, r.skill_id,
    count(r.image_id) as rej_count
  from rejections r join kept k on k.image_id = r.image_id and k.skill_id = r.skill_id
  where receiver_id is not null and is_customer is null group by all),
customer_ as (
  select cast(extract(month from rejected_at) as int) as month, r.skill_id,
    count(r.image_id) as cust_rej_count
  from rejections r join kept k on k.image_id = r.image_id and k.skill_id = r.skill_id
  where is_customer = 1 group by all)
select k.month, skill_name, k.skill_id, count(distinct image_id) as img_count, rej_count,
  {_rnd(_ratio('rej_count', 'count(distinct image_id)'), 4)} as rej_rate, cust_rej_count,
  {_rnd(_ratio('cust_rej_count', 'count(distinct image_id)'), 6)} as cust_rej_rate,
  {_rnd(_ratio('sum(actual_ms)', '3600000'), 2)} as actual_hours,
  {_rnd(_ratio('sum(expected_ms)', '3600000'), 2)} as expected_hours,
  {_rnd(_ratio('sum(actual_ms)', 'sum(expected_ms)'), 2)} as efficiency
from kept k left join internal a on a.month = k.month and a.skill_id = k.skill_id
  left join customer_ b on b.month = k.month and b.skill_id = k.skill_id
group by k.month, skill_name, k.skill_id, rej_count, cust_rej_count""")

MASK_CTES = """latest as (
  select image_id, max(created_at) as created_at from mask_quality
  where created_at + interval '7' hour >= timestamp '1995-01-01' group by image_id),
good as (
  select l.image_id, l.created_at
  from mask_quality m join latest l on l.image_id = m.image_id and m.created_at = l.created_at
    join steps s on s.image_id = l.image_id and s.skill_id = 121
  where grade = 'Good' group by l.image_id, l.created_at
  having sum(case when s.worker_id is not null then 1 else 0 end) > 0)"""


def mask_rate(join: str) -> str:
    return with_views(f"""
with {MASK_CTES}
select cast(g.created_at + interval '7' hour as date) as date, 'Good' as grade,
  {_rnd(_ratio('count(r.receiver_id)', 'count(distinct g.image_id)'), 4)} as rej_rate,
  count(distinct g.image_id) as img_count, count(r.receiver_id) as rej_count
from good g {join} rejections r on r.image_id = g.image_id and r.skill_id = 121
group by 1""")


def paged(sql: str, order: str, limit: int, offset: int = 0) -> str:
    return f"select * from ({sql}) order by {order} limit {limit} offset {offset}"
