import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crewmetrics.operators import ranking


def skewed(spark, n=4000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}"
        # Half of the hot group ties on one value.
        value = 1.0 if group == "hot" and rng.random() < 0.5 else rng.randrange(300) / 100
        rows.append((group, value, i))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double, id long").repartition(6)


def test_row_numbers_match_brute_force(spread, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 100)  # the ties of the hot group's value fall into many ranges
    rows, df = skewed(spread)
    numbered = ranking.number_rows(df, ["g"], "v", ["id"])
    got = {(r.g, r.id): (r.row_no, r.group_size) for r in numbered.collect()}
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((v, i))
    want = {
        (g, i): (n, len(members))
        for g, members in groups.items()
        for n, (v, i) in enumerate(sorted(members), 1)
    }
    assert got == want


def test_a_hot_group_and_its_commonest_value_span_tasks(spread, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE", 100)
    spread.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, df = skewed(spread)
        numbered = ranking.number_rows(df, ["g"], "v", ["id"]).withColumn("task", F.spark_partition_id())
        tied = numbered.filter("g = 'hot' and v = 1.0")
        assert tied.select("task").distinct().count() > 1
        assert numbered.groupBy("task").count().agg(F.max("count")).first()[0] < len(rows) / 2
    finally:
        spread.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nothing_runs_or_is_sorted_as_a_whole_while_the_plan_is_built(spark):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranking", "ranking")
    rows, df = skewed(spark, 500)
    numbered = ranking.number_rows(df, ["g"], "v", ["id"])
    ranked = ranking.rank_rows(df, ["g"], "v")
    assert not status.getJobIdsForGroup("ranking")
    for plan in (numbered, ranked):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and "SinglePartition" not in text and "Parquet" not in text
    spark.sparkContext.setJobGroup("", "")


def test_ranks_share_ties(spread):
    rows, df = skewed(spread, 1500)
    got = {(r.g, r.id): r["rank"] for r in ranking.rank_rows(df, ["g"], "v").collect()}
    values = defaultdict(list)
    for g, v, _ in rows:
        values[g].append(v)
    want = {(g, i): 1 + sum(x < v for x in values[g]) for g, v, i in rows}
    assert got == want


def test_order_of_input_does_not_matter(spread):
    rows, df = skewed(spread, 800)
    again = spread.createDataFrame(sorted(rows, key=lambda r: -r[2]), df.schema)

    def numbers(x):
        return sorted(map(tuple, ranking.number_rows(x, ["g"], "v", ["id"]).collect()))

    assert numbers(df) == numbers(again)


def test_null_values_rank_last_and_null_groups_are_groups(spark):
    rows = [("a", 2.0, 1), ("a", None, 2), ("a", None, 3), (None, 1.0, 4), (None, None, 5), ("a", 1.0, 6)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    numbers = {r.id: (r.row_no, r.group_size) for r in ranking.number_rows(df, ["g"], "v", ["id"]).collect()}
    assert numbers == {6: (1, 4), 1: (2, 4), 2: (3, 4), 3: (4, 4), 4: (1, 2), 5: (2, 2)}
    ranks = {r.id: r["rank"] for r in ranking.rank_rows(df, ["g"], "v").collect()}
    assert ranks == {6: 1, 1: 2, 2: 3, 3: 3, 4: 1, 5: 2}


def test_values_of_any_sign_and_size(spark):
    values = [0.0, -0.0, 5e-324, 1e-300, 1.0, 1.0 + 2**-52, 1e300, -5e-324, -1.0, -1e300, float("inf"), float("-inf")]
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)], "g string, v double, id long")
    got = {r.id: r.row_no for r in ranking.number_rows(df, ["g"], "v", ["id"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert got == {i: n for n, i in enumerate(order, 1)}


@pytest.mark.parametrize("third", [0, 1])
def test_several_ranks_at_once(spread, third):
    rows, df = skewed(spread, 1500)
    counters = {"all": ("n", F.lit(True)), "some": ("m", F.col("id") % 3 == third)}
    got = {(r.g, r.id): (r.all, r.some, r.m) for r in ranking.rank_rows(df, ["g"], "v", counters).collect()}
    values = defaultdict(list)
    for g, v, i in rows:
        values[g].append((v, i))
    want = {
        (g, i): (
            1 + sum(x < v for x, _ in values[g]),
            1 + sum(x < v and j % 3 == third for x, j in values[g]),
            sum(j % 3 == third for _, j in values[g]),
        )
        for g, v, i in rows
    }
    assert got == want
