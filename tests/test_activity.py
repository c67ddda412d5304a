import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.timeops import Window
from crewmetrics.operators import activity as A

LOG = (
    "event_id long, worker_id long, image_id long, login_type_id int, activity_type_id int, "
    "application_name string, runtime_ms long, time_at timestamp_ntz"
)
OUT = "event_id long, worker_id long, requested_at timestamp_ntz, reason_id int"
MEAL = "event_id long, worker_id long, start_at timestamp_ntz, finish_at timestamp_ntz"
T0 = dt.datetime(2020, 1, 1)


def codes(spark, rules, *cases):
    rows = [
        (i, 1, image, login, code, app, 10, T0) for i, (image, login, code, app) in enumerate(cases)
    ]
    df = A.classify_activity(spark.createDataFrame(rows, LOG), rules)
    return [r.code for r in df.orderBy("event_id").collect()]


CASES = [
    (7, 0, None, "Firefox"),  # image and login type 0
    (7, 1, 0, "Firefox"),  # image and code 0
    (0, 0, 0, "Firefox"),  # no image
    (None, 1, None, "Firefox"),  # no code: guard unknown
    (0, 1, 12, "Google Chrome"),
    (0, 1, 11, "Google Chrome"),
    (0, 1, 11, "Brave Browser"),
    (0, 1, 11, "smoothXpath.exe"),  # underscore is a wildcard
    (0, 1, 11, "INTERNET EXPLORER 9"),  # the explorer rule comes first
    (0, 1, 11, "photoshop"),  # exact names keep their case
    (0, 1, -1, "Skype"),
    (0, 1, 14, "Skype"),
    (0, 1, 11, None),
]


def test_classifier_rules(spark):
    assert codes(spark, C.RULES_V2, *CASES) == [
        110, 110, 1312, 411, 1093, 1001, 1312, 1001, 310, 411, -1, 514, 411,
    ]
    assert codes(spark, C.RULES_V1, *CASES) == [
        110, 110, 1312, 1312, 1312, 1312, 411, 1001, 310, 411, -1, 514, 411,
    ]
    assert codes(spark, C.RULES_V2_14, (0, 1, 14, "Skype")) == [14]


def test_further_tools_can_be_named(spark):
    rules = C.RULES_V2.with_tools(("upper", "HOUSECLIENT%"))
    assert codes(spark, rules, (0, 1, 11, "HouseClient 2")) == [1001]
    assert codes(spark, C.RULES_V2, (0, 1, 11, "HouseClient 2")) == [411]


def log_row(i, worker, at, ms=1000, code=7):
    return (i, worker, 0, 1, code, "x", ms, at)


def brute_gaps(log, outs):
    by_worker = defaultdict(list)
    for r in log:
        by_worker[r[1]].append((r[7], 0, r[0], None))
    for r in outs:
        by_worker[r[1]].append((r[2], 1, r[0], r[3]))
    found = set()
    for events in by_worker.values():
        events.sort(key=lambda e: e[:3])
        for this, after in zip(events, [*events[1:], None]):
            if this[1] == 1 and this[3] not in (None, 6):
                ms = None
                if after is not None:
                    ms = int(after[0].timestamp() * 1000) - int(this[0].timestamp() * 1000)
                found.add((this[2], 1091 if this[3] == 7 else 1092, ms))
    return found


def test_logout_gaps_across_slices_match_brute_force(spread):
    rng = random.Random(5)
    # Worker 1 holds most events; some gaps cross many empty slices.
    def when():
        return T0 + dt.timedelta(milliseconds=rng.randrange(5 * 86_400_000))

    log = [log_row(i, 1 if rng.random() < 0.6 else rng.randrange(2, 9), when()) for i in range(900)]
    outs = [
        (10_000 + i, 1 if rng.random() < 0.6 else rng.randrange(2, 9), when(),
         rng.choice([1, 6, 7, None]))
        for i in range(300)
    ]
    df = A.logout_gaps(
        spread.createDataFrame(log, LOG), spread.createDataFrame(outs, OUT), slice_seconds=1800
    )
    got = {(r.event_id, r.code, r.runtime_ms) for r in df.collect()}
    assert got == brute_gaps(log, outs)


def test_last_event_keeps_no_duration_but_counts_for_the_shift_end(spark):
    start = dt.datetime(2020, 1, 1, 23, 20)  # 06:20 local, five minutes into the shift
    log = spark.createDataFrame([log_row(1, 1, start)], LOG)
    outs = spark.createDataFrame([(2, 1, start + dt.timedelta(minutes=430), 1)], OUT)
    meals = spark.createDataFrame([], MEAL)
    events = A.timed_events(log, outs, meals)
    gap = events.filter("code = 1092").first()
    assert gap.runtime_ms is None
    flagged = A.with_normal_flag(A.shift_times(events)).collect()
    assert {(r.code, r.ms, r.is_normal) for r in flagged} == {(7, 1000, 1), (1092, None, 1)}
    marks = A.timed_events(log, outs, meals, gap_durations=False)
    assert A.normal_shifts(A.shift_times(marks)).count() == 1
    assert A.normal_shifts(A.shift_times(marks), min_end=455).count() == 0


def test_window_ends_before_the_lead(spark):
    log = spark.createDataFrame([log_row(1, 1, T0 + dt.timedelta(hours=2))], LOG)
    outs = spark.createDataFrame([(2, 1, T0, 7)], OUT)
    inside = A.logout_gaps(log, outs, Window(T0, T0 + dt.timedelta(hours=3))).first()
    assert (inside.code, inside.runtime_ms) == (1091, 7_200_000)
    cut = A.logout_gaps(log, outs, Window(T0, T0 + dt.timedelta(hours=1))).first()
    assert cut.runtime_ms is None


def test_rollup_is_the_sum_of_its_members(spark):
    rows = [(dt.date(2020, 1, 1), 0, 1, c, 10 * c + 1000) for c in (110, 10, 5, 7, 9, 1091, 1)]
    times = spark.createDataFrame(rows, "date date, shift int, worker_id long, code int, ms long")
    rolled = {r.code: r.ms for r in A.rollup_categories(times, C.ROLLUPS_PRODUCTION).collect()}
    base = {r[3]: r[4] for r in rows}
    assert {c: rolled[c] for c in base} == base
    assert rolled[7116] == base[110] + base[10]
    assert rolled[7117] == rolled[7116] + base[5]
    assert rolled[1111] == base[1]  # meal gaps are listed but never rolled up
    fixed = A.rollup_categories(times, C.ROLLUPS_PRODUCTION, with_gaps=True)
    assert {r.code: r.ms for r in fixed.collect()}[1111] == base[1] + base[1091]


def test_hours_over_categories_add_up(spark):
    rng = random.Random(1)
    log = [
        log_row(i, i % 5, T0 + dt.timedelta(minutes=rng.randrange(9000)), rng.randrange(9999), i % 12)
        for i in range(500)
    ]
    events = A.classify_activity(spark.createDataFrame(log, LOG))
    total = A.working_time(events).agg(F.sum("ms")).first()[0]
    assert total == sum(r[6] for r in log)
    by_worker = A.working_time(events, by_category=False).agg(F.sum("ms")).first()[0]
    assert by_worker == total


def test_classifiers_differ_only_where_their_rules_do(spark):
    """Chrome, Brave, code 12 and missing codes are the only rows the versions disagree on."""
    apps = ["Google Chrome", "Brave", "Firefox", "IDLE", "Notepad++ 7", "Skype", "other", None]
    rows = [
        (0, 1, code, app) for code in (None, 0, 1, 11, 12, 14) for app in apps
    ]
    one, two = codes(spark, C.RULES_V1, *rows), codes(spark, C.RULES_V2, *rows)
    for (_, _, code, app), a, b in zip(rows, one, two):
        if a != b:
            assert code in (None, 12) or app in ("Google Chrome", "Brave")
