import datetime as dt

import pytest

from crewmetrics.operators import workforce as P

WORKERS = (
    "worker_id long, worker_name string, office_id int, planning_group_id int, is_locked int"
)


@pytest.fixture(scope="module")
def workers(spark):
    rows = [
        (1, "Ann", 4, 10, 0),
        (2, "AUTO mask", 4, 10, None),
        (3, "Big bot three", 2, 11, 0),
        (4, "A Tester", 2, 11, 0),
        (5, "Eve", 2, 11, 1),
        (6, "Bob", 4, 10, None),
        (7, None, 4, 10, 0),
    ]
    return spark.createDataFrame(rows, WORKERS)


@pytest.fixture(scope="module")
def roles(spark):
    held = [(1, 3), (1, 8), (2, 33), (3, 3), (4, 3), (5, 3), (5, 33), (6, 9), (1, 9), (5, 9), (7, 3)]
    return spark.createDataFrame(held, "worker_id long, role_id int")


def test_cohort(workers, roles):
    got = {(r.worker_id, r.group_id) for r in P.worker_cohort(workers, roles).collect()}
    # Worker 1 shows under both groups, 5 once for two roles, 4 and 7 fail the name rules.
    assert got == {(1, 4), (1, 999), (2, 998), (3, 998), (5, 2)}


def test_office_labels_keep_both_sides(spark):
    offices = spark.createDataFrame([(4, "East"), (77, "New")], "office_id int, office_name string")
    labels = P.office_labels(offices, [(4, "2"), (998, "6_AutoBot")]).collect()
    assert {r.group_id: r.office for r in labels} == {4: "2_East", 77: "_New", 998: "6_AutoBot"}


def test_team_is_the_first_unlocked_leader(workers, roles):
    teams = {r.planning_group_id: r.team for r in P.team_names(workers, roles).collect()}
    assert teams == {10: "Ann"}


def test_registered_shift_uses_the_local_clock(spark, workers):
    rows = [
        (1, 6, dt.datetime(2020, 1, 2, 0, 0)),
        (1, 99, dt.datetime(2020, 1, 2, 6, 15)),
        (1, 6, dt.datetime(2020, 1, 2, 6, 15)),
    ]
    reports = spark.createDataFrame(
        rows, "worker_id long, leader_id long, shift_start_local timestamp_ntz"
    )
    got = sorted(
        (str(r.date), r.shift, r.team_shift or "")
        for r in P.registered_shifts(reports, workers).collect()
    )
    # Midnight belongs to the last shift of the new date; duplicates stay.
    assert got == [("2020-01-02", 0, ""), ("2020-01-02", 0, "Bob"), ("2020-01-02", 2, "Bob")]


def test_exclusion(workers):
    left = {r.worker_id for r in P.exclude_workers(workers, (1, 2)).collect()}
    assert left == {3, 4, 5, 6, 7}
    assert P.exclude_workers(workers, ()).count() == 7
