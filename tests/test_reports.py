import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference, duck
from crewmetrics.functions.timeops import pay_window
from crewmetrics.plans import catalogue, registry, reports
from crewmetrics.plans.reports import page
from crewmetrics.session import shared_dir
from crewmetrics.sources.adapters import driver_warehouse
from crewmetrics.sources.schemas import SCHEMAS, read_warehouse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert set(catalogue.CATALOGUE) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_pages_do_not_overlap(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    seen = []
    for offset in (0, 20, 40):
        seen += [(r.k, r.id) for r in page(df, ["-k"], 20, offset).collect()]
    assert seen == sorted(((i % 3, i) for i in range(50)), key=lambda x: (-x[0], x[1]))


def test_nulls_sort_as_the_largest_value(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert [r.k for r in page(df, ["k"]).collect()] == [1, 2, None]
    assert [r.k for r in page(df, ["-k"], limit=1).collect()] == [None]


def test_catalogue_runs_from_declared_schemas(spark, tmp_path):
    """All named reports build over an empty warehouse of the declared schemas."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    wh = read_warehouse(spark, str(tmp_path))
    for name in catalogue.CATALOGUE:
        assert catalogue.run_page(name, wh, dt.date(2021, 3, 1)).columns, name


def test_reports_over_a_filled_declared_warehouse(spark, tmp_path):
    """The public reader gives the rows that the adapters give."""
    adapted = driver_warehouse(spark, SF)
    for name, schema in SCHEMAS.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        relation = getattr(adapted, name).select(*columns)
        fields = spark.createDataFrame([], schema).schema
        relation.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(str(tmp_path / name))
    read = read_warehouse(spark, str(tmp_path))
    since = dt.datetime(1995, 1, 1)
    for name, more in (
        ("mastery_month_boundary_1mo", {"volume": registry.VOLUME, "since": since}),
        ("trimmed_worker_levels", {"dates": registry.EVERY_DAY}),
        ("mask_quality_rate", {"since": since}),
    ):
        rows = [
            sorted(map(str, catalogue.run(name, wh, dt.date(1995, 1, 10), **more).collect()))
            for wh in (adapted, read)
        ]
        assert rows[0] and rows[0] == rows[1], name


def test_bounds_inside_the_data_cut(spark):
    for cut, whole in (
        ("mastery_month_average_cut", "mastery_month_average_12mo"),
        ("mastery_week_boundary_cut", "mastery_week_boundary_20wk"),
        ("shift_worker_all_cut", "shift_worker_all_groups"),
        ("daily_all_types_cut", "daily_all_types_2mo"),
        ("customer_images_cut", "customer_images_24wk"),
        ("customer_rejections_one_skill", "customer_rejections_24wk"),
    ):
        few, all_ = (registry.QUERIES[n](spark, SF).count() for n in (cut, whole))
        assert 0 < few < all_, cut


def test_plans_have_no_nested_loops_or_cross_joins(spark):
    for name in ("shift_worker_totals_4mo", "customer_rejections_24wk", "worker_skill_stats"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_each_fact_is_scanned_once(spark):
    df = registry.QUERIES["worker_skill_stats"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # One scan for the steps, one for the rejections adapter.
    assert plan.count("lineitem.parquet") == 2


def jobs_in(spark, build) -> int:
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    build()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


@pytest.mark.parametrize("name", ["shift_worker_totals_4mo", "shift_team_1mo", "daily_all_types_2mo"])
def test_no_job_runs_while_a_shift_report_is_built(spark, name):
    assert jobs_in(spark, lambda: registry.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["shift_worker_totals_4mo", "shift_team_1mo", "daily_all_types_2mo"])
def test_reports_are_the_same_without_broadcasts(spark, con, name):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        assert difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) is None
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_narrowing_the_look_ahead_does_not_change_a_report(spark, monkeypatch):
    wh = driver_warehouse(spark, SF)
    window = pay_window(dt.date(2024, 1, 15), 1, 1)
    groups = (2, 3, 999)
    narrowed = sorted(map(str, reports.report_office_shift(wh, window, groups=groups).collect()))
    monkeypatch.setattr(reports, "_ids", lambda cohort: None)
    assert sorted(map(str, reports.report_office_shift(wh, window, groups=groups).collect())) == narrowed
    assert narrowed


@pytest.mark.parametrize(
    "name", ["mastery_month_boundary_1mo", "mastery_week_average_12wk", "trimmed_worker_levels", "trimmed_expert_bounds_month"]
)
def test_ranked_reports_write_no_table_and_run_no_job_while_built(spark, name):
    assert jobs_in(spark, lambda: registry.QUERIES[name](spark, SF)) == 0
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem.parquet" in plan and "rangepartitioning" not in plan


def test_a_folder_must_be_named():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        shared_dir(Unset)
