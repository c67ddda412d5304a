import datetime as dt
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions.timeops import local_since
from crewmetrics.operators import mastery as M

FACTS = (
    "image_id long, skill_id int, worker_id long, skill_name string, period int, "
    "actual_s long, expected_ms long"
)
INTERNAL = "image_id long, skill_id int, worker_id long, period int"
STATS = (
    "period int, skill_id int, worker_id long, skill_name string, office_name string, "
    "img_count long, efficiency double"
)


@pytest.fixture(scope="module")
def workers(spark):
    rows = [(i, f"Worker {i}", dt.date(2015, 1, 1), "Delta Office") for i in range(20)]
    rows += [(90, "Auto nine", None, "Delta Office"), (91, "a Bot b", None, "Dock Office")]
    return spark.createDataFrame(
        rows, "worker_id long, worker_name string, joined_date date, office_name string"
    )


def stats_of(spark, efficiencies, images=10, period=202101):
    rows = [
        (period, 1, w, "one", "Delta Office" if w % 2 else "Metro Office", images, e)
        for w, e in efficiencies.items()
    ]
    return spark.createDataFrame(rows, STATS)


ANY = C.MinVolume({}, 0)


def test_units_match_brute_force(spread, workers):
    rng = random.Random(11)

    def key():
        hot = rng.random() < 0.4
        return (1, 1, 1) if hot else (rng.randrange(40), rng.randrange(1, 4), rng.randrange(6))

    facts = [
        (*k, f"s{k[1]}", 202100 + rng.randrange(1, 5), rng.randrange(1, 50), rng.randrange(1, 9) * 1000)
        for k in (key() for _ in range(600))
    ]
    internal = [(*key(), 202100 + rng.randrange(1, 6)) for _ in range(150)]
    units = M.rejection_units(
        spread.createDataFrame(facts, FACTS), spread.createDataFrame(internal, INTERNAL)
    )
    got = {
        (r.period, r.skill_id, r.worker_id): (r.img_count, r.sum_actual_s, r.rej_img_count)
        for r in M.worker_skill_stats(units, workers, keep_zero_rejections=True).collect()
    }
    rejected = {(*f[:3], f[4]) for f in facts} & set(internal)
    ever = {r[:3] for r in rejected}
    work, counts = defaultdict(lambda: [0, 0]), defaultdict(int)
    for f in facts:
        if f[:3] not in ever:
            work[(f[4], f[1], f[2])][0] += 1
            work[(f[4], f[1], f[2])][1] += f[5]
    for image, skill, worker, period in rejected:
        counts[(period, skill, worker)] += 1
    want = {k: (n, s, counts[k]) for k, (n, s) in work.items()}
    assert got == want
    strict = M.worker_skill_stats(units, workers)
    assert {(r.period, r.skill_id, r.worker_id) for r in strict.collect()} == {
        k for k in want if counts[k]
    }
    # The row-level operators agree with the fused one.
    rej = M.period_rejections(
        spread.createDataFrame(internal, INTERNAL), spread.createDataFrame(facts, FACTS)
    )
    assert {tuple(r) for r in rej.select(*M.UNIT, "period").collect()} == rejected
    left = M.accepted_steps(spread.createDataFrame(facts, FACTS), rej).count()
    assert left == sum(n for n, _ in work.values())


def test_workers_without_rejections_are_left_out(spark, workers):
    facts = spark.createDataFrame(
        [(1, 1, 1, "s", 202101, 5, 4000), (2, 1, 1, "s", 202101, 5, 4000),
         (3, 1, 2, "s", 202101, 5, 4000), (4, 1, 90, "s", 202101, 5, 4000)],
        FACTS,
    )
    internal = spark.createDataFrame([(1, 1, 1, 202101), (4, 1, 90, 202101)], INTERNAL)
    units = M.rejection_units(facts, internal)
    row = M.worker_skill_stats(units, workers).collect()
    assert [(r.worker_id, r.img_count, r.rej_rate, r.efficiency) for r in row] == [(1, 1, 0.5, 1.25)]
    everyone = M.worker_skill_stats(units, workers, keep_zero_rejections=True).collect()
    assert {(r.worker_id, r.rej_img_count) for r in everyone} == {(1, 1), (2, 0)}


def test_a_worker_without_actual_times_is_ranked_last(spark, workers):
    """One of two workers has no actual time: both are reported, the other one is the expert."""
    facts = spark.createDataFrame(
        [(1, 1, 1, "s", 202101, None, 4000), (2, 1, 1, "s", 202101, None, 4000),
         (3, 1, 2, "s", 202101, 10, 4000), (4, 1, 2, "s", 202101, None, 4000),
         (5, 1, 2, "s", 202101, 10, 4000)],
        FACTS,
    )
    internal = spark.createDataFrame([(2, 1, 1, 202101), (5, 1, 2, 202101)], INTERNAL)
    stats = M.worker_skill_stats(M.rejection_units(facts, internal), workers)
    means = {r.worker_id: (r.avg_actual_s, r.img_count) for r in stats.collect()}
    assert means == {1: (None, 1), 2: (10.0, 2)}  # the mean leaves missing times out
    rows = {r.worker_id: (r.efficiency_rank, r.mastery_level) for r in
            M.mastery_zones(stats, ANY, C.AVERAGE_RULE).collect()}
    assert rows == {2: (1, "Expert"), 1: (2, None)}


def test_tie_at_the_expert_rank_leaves_no_bound(spark):
    # Twelve workers give a quota of two, but the best two share rank 1.
    eff = {w: 1.0 + max(0, w - 1) / 10 for w in range(12)}
    zones = M.mastery_zones(stats_of(spark, eff), ANY, C.BOUNDARY_RULE)
    rows = zones.collect()
    assert {r.expert_quota for r in rows} == {2}
    assert {r.expert_bound for r in rows} == {None}
    assert {r.mastery_level for r in rows} == {None}
    bridged = M.mastery_zones(stats_of(spark, eff), ANY, replace(C.BOUNDARY_RULE, bridge_ties=True))
    assert {r.expert_bound for r in bridged.collect()} == {1.0}


def test_levels_of_the_average_rule(spark):
    eff = {0: 1.0, 1: 1.3, 2: 1.30001, 3: 1.5, 4: 1.50001}
    zones = M.mastery_zones(stats_of(spark, eff), ANY, C.AVERAGE_RULE)
    got = {r.worker_id: (r.mastery_level, r.efficiency_rank) for r in zones.collect()}
    assert got == {
        0: ("Expert", 1),
        1: ("Master", 2),
        2: ("Premaster", 3),
        3: ("Premaster", 4),
        4: ("Bottom", 5),
    }
    three = M.mastery_zones(stats_of(spark, eff), ANY, C.AVERAGE_RULE_NO_EXPERT)
    assert {r.worker_id: r.mastery_level for r in three.collect()}[0] == "Master"


def test_levels_of_the_boundary_rule(spark):
    eff = {0: 1.0, 1: 1.3, 2: 1.3001, 3: 1.5, 4: 1.5001}
    zones = M.mastery_zones(stats_of(spark, eff), ANY, C.BOUNDARY_RULE)
    assert {r.worker_id: r.mastery_level for r in zones.collect()} == {
        0: "Expert", 1: "Master", 2: "Premaster", 3: "Premaster", 4: "Bottom",
    }
    assert {r.distance_from_mastery for r in zones.filter("worker_id = 3").collect()} == {0.2}


def test_bounds_come_from_workers_with_enough_images_only(spark):
    few = stats_of(spark, {0: 0.1}, images=1)
    many = stats_of(spark, {1: 1.0, 2: 1.2}, images=10)
    zones = M.mastery_zones(few.union(many), C.MinVolume({1: 5}, 50), C.AVERAGE_RULE)
    rows = {r.worker_id: r for r in zones.collect()}
    assert {r.expert_bound for r in rows.values()} == {1.0}
    assert (rows[0].efficiency_rank, rows[0].mastery_level) == (1, "Expert")


def test_levels_cover_every_worker_with_a_bound(spread):
    rng = random.Random(2)
    stats = stats_of(spread, {w: round(rng.uniform(0.5, 3), 5) for w in range(200)})
    for rule in (C.AVERAGE_RULE, C.BOUNDARY_RULE):
        zones = M.mastery_zones(stats, ANY, rule)
        assert zones.filter("mastery_level is null and expert_bound is not null").count() == 0
        assert zones.count() == 200


def test_office_prefix_filters_after_ranking(spark):
    zones = M.mastery_zones(
        stats_of(spark, {w: 1 + w / 10 for w in range(6)}), ANY, C.AVERAGE_RULE, "D"
    )
    assert {r.worker_id: r.efficiency_rank for r in zones.collect()} == {1: 2, 3: 4, 5: 6}


def test_volume_tables():
    monthly, weekly = C.MONTHLY_VOLUME, C.WEEKLY_VOLUME
    assert (monthly.by_skill[479], monthly.by_skill[1], monthly.default) == (100, 500, 50)
    assert 479 not in weekly.by_skill and weekly.by_skill[15] == 5
    assert len(C.MASTERY_SKILLS) == len(set(C.MASTERY_SKILLS)) == 67


def test_rejections_of_customers_and_without_receiver_are_ignored(spark):
    rows = [
        (1, 1, 5, dt.datetime(2021, 1, 5), None),
        (2, 1, 5, dt.datetime(2021, 1, 5), 0),
        (3, 1, 5, dt.datetime(2021, 1, 5), 1),
        (4, 1, None, dt.datetime(2021, 1, 5), 0),
        (5, 1, 5, dt.datetime(2020, 12, 31), 0),
    ]
    rejections = spark.createDataFrame(
        rows,
        "image_id long, skill_id int, receiver_id long, rejected_at timestamp_ntz, is_customer int",
    )
    kept = M.internal_rejections(rejections, dt.datetime(2021, 1, 1))
    assert {r.image_id for r in kept.collect()} == {1, 2}


def test_since_is_on_the_local_clock(spark):
    times = [(dt.datetime(2020, 12, 31, 16, 59),), (dt.datetime(2020, 12, 31, 17, 0),)]
    df = spark.createDataFrame(times, "at timestamp_ntz")
    assert df.filter(local_since("at", dt.datetime(2021, 1, 1))).count() == 1
    assert df.filter(local_since("at", dt.datetime(2021, 1, 1), strict=True)).count() == 0
    assert df.filter(F.lit(True)).count() == 2


def test_a_hot_unit_is_split_by_adaptive_execution(spread):
    """One image, skill and worker with most of the rows does not stay in one task."""
    spark = spread
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 60_000, 1, 12)
        key = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))
        facts = ids.select(
            key.alias("image_id"), F.lit(1).alias("skill_id"), F.lit(1).cast("long").alias("worker_id"),
            F.lit("s").alias("skill_name"), F.lit(202101).alias("period"),
            F.col("id").alias("actual_s"), F.lit(1000).cast("long").alias("expected_ms"),
        )
        internal = ids.filter("id % 5 = 0").select(
            "id", F.lit(1).alias("skill_id"), F.lit(1).cast("long").alias("worker_id"),
            F.lit(202101).alias("period"),
        ).withColumnRenamed("id", "image_id")
        units = M.rejection_units(facts, internal)
        assert units.agg(F.sum("img_count")).first()[0] == 60_000
        rows = units.collect()
        plan = units._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert len(rows) == 20_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
