import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from crewmetrics.operators import trimmed as T

IMAGES = (
    "period int, skill_id int, skill_name string, worker_id long, image_id long, line_no int, "
    "part_id long, assign_at timestamp_ntz, actual_ms long, expected_ms long, efficiency double"
)


def images_of(spark, values, skill=1):
    rows = [
        (1, skill, f"s{skill}", w, i, 1, 1, dt.datetime(2020, 1, 1), int(v * 1000), 1000, float(v))
        for i, (w, v) in enumerate(values)
    ]
    return spark.createDataFrame(rows, IMAGES)


@pytest.mark.parametrize("count, left", [(1, 0), (9, 8), (10, 7), (29, 26), (30, 25), (100, 89)])
def test_trim_drops_n_below_and_n_plus_one_above(spark, count, left):
    ranked = T.rank_images(images_of(spark, [(1, v + 1) for v in range(count)]))
    kept = T.trim_by_rank(ranked)
    n = int(Decimal(count) * Decimal("0.05") + Decimal("0.5"))
    assert kept.count() == left == max(0, count - 2 * n - 1)
    assert T.trim_by_rank(ranked, symmetric=True).count() == count - 2 * n
    if left:
        ranks = sorted(r.image_rank for r in kept.collect())
        assert (ranks[0], ranks[-1]) == (n + 1, count - n - 1)


def test_sole_worker_images(spark):
    at = dt.datetime(2020, 5, 1)
    rows = [
        (1, 1, 7, at, 10), (1, 1, 7, at, 10),  # one worker, twice
        (2, 1, 7, at, 10), (2, 1, 8, at, 10),  # two workers
        (3, 1, 7, at, 10), (3, 1, 8, at, 5),  # the second report does not count
        (4, 2, 7, at, 10),  # not a production skill
        (5, 1, 7, dt.datetime(2020, 4, 1), 10),  # on an open end of the range
    ]
    reports = spark.createDataFrame(
        rows, "image_id long, skill_id int, worker_id long, created_at timestamp_ntz, status_id int"
    )
    skills = spark.createDataFrame([(1, 0), (2, 1)], "skill_id int, skill_kind_id int")
    opened = T.DateRange(dt.date(2020, 4, 1), dt.date(2020, 6, 1))
    got = {(r.image_id, r.worker_id) for r in T.sole_worker_images(reports, skills, opened).collect()}
    assert got == {(1, 7), (3, 7)}
    closed = T.DateRange(dt.date(2020, 4, 1), dt.date(2020, 6, 1), inclusive=True)
    assert T.sole_worker_images(reports, skills, closed).count() == 3


def test_worker_chain_matches_brute_force(spread):
    rng = random.Random(4)
    # Worker 1 holds most images and half of them share one efficiency.
    values = [
        (1, 1.0 if rng.random() < 0.5 else rng.randrange(500, 3000) / 1000)
        if rng.random() < 0.5
        else (rng.randrange(2, 14), rng.randrange(500, 3000) / 1000)
        for _ in range(1200)
    ]
    ranked = T.worker_efficiency(T.trim_by_rank(T.rank_images(images_of(spread, values))))
    rows = sorted((v, i, w) for i, (w, v) in enumerate(values))
    n = 60
    sums = defaultdict(lambda: [0, 0])
    for v, _, w in rows[n : len(rows) - n - 1]:
        sums[w][0] += int(v * 1000)
        sums[w][1] += 1000
    order = sorted((a / e, w) for w, (a, e) in sums.items())
    got = {r.worker_rank: (r.efficiency, r.worker_id) for r in ranked.collect()}
    assert got == dict(enumerate(order, 1))

    c = len(order)
    quota = {share: int(Decimal(c) * Decimal(share) + Decimal("0.5")) for share in ("0.25", "0.5", "0.1")}
    zone = T.zone_boundary_values(ranked).first()
    assert (zone.masters, zone.premasters) == (quota["0.25"], quota["0.5"])
    assert zone.mastery_zone == order[quota["0.25"] - 1][0]
    assert zone.premastery_zone == order[quota["0.5"] - 1][0]
    quotas = T.level_quotas(ranked).first()
    assert quotas.masters + quotas.premasters + quotas.bottoms == quotas.worker_count == c
    levels = defaultdict(int)
    for r in T.worker_levels(ranked).collect():
        levels[r.mastery_level] += 1
    assert levels["Master"] == quotas.masters and levels["Pre-Master"] == quotas.premasters
    bound = T.expert_bounds(ranked).first()
    assert bound.expert_quota == quota["0.1"]
    assert bound.expert_bound_rank == pytest.approx(order[quota["0.1"] - 1][0], abs=0.005)


def test_small_groups_have_no_master_boundary(spark):
    ranked = T.worker_efficiency(images_of(spark, [(1, 1.5)]))
    zone = T.zone_boundary_values(ranked).first()
    assert (zone.masters, zone.premasters, zone.bottoms) == (0, 1, 0)
    assert (zone.mastery_zone, zone.premastery_zone) == (None, 1.5)
    assert T.worker_levels(ranked).first().mastery_level == "Pre-Master"
