import datetime as dt

import pytest

from crewmetrics.operators import quality as Q
from crewmetrics.sources.schemas import SCHEMAS, Warehouse

T0 = dt.datetime(2020, 5, 4, 20, 0)  # 5 May on the local clock


@pytest.fixture(scope="module")
def wh(spark):
    def step(image, line, worker, actual, template="Template A", customer=1, skill=121):
        return (image, line, 1, skill, f"s{skill}", worker, T0, actual // 1000, actual, 1000,
                customer, template)

    data = {
        "workers": [(1, "Ann", 4, 1, 0, "E1", "a@x", "Delta Office", None),
                    (2, "auto x", 4, 1, 0, "E2", "b@x", "Delta Office", None)],
        "skills": [(121, "s121", 0, 1), (5, "s5", 0, 2)],
        "images": [(1,), (2,), (3,)],
        "customers": [(1, "One"), (2, "Two")],
        "templates": [(10, "Template A", 1, 0), (11, "Template B", 1, 1), (12, "Template A", 2, None)],
        "steps": [
            step(1, 1, 1, 1000), step(1, 2, 1, 3000), step(2, 1, 1, 2000), step(3, 1, 2, 500),
            step(9, 1, 1, 700),  # unknown image
            step(2, 2, 1, 900, "Template B"),  # deleted template
            step(2, 3, 1, 900, "Template A", 2),  # deletion unknown
        ],
        "rejections": [
            (1, 121, 1, T0, None), (1, 121, 1, T0, 1), (1, 121, None, T0, None), (2, 121, 1, T0, 0),
            (1, 5, 1, T0, None),
        ],
        "mask_quality": [
            (1, T0, "Bad"), (1, T0 + dt.timedelta(1), "Good"), (1, T0 + dt.timedelta(1), "Bad"),
            (2, T0, "Good"), (2, T0 + dt.timedelta(1), "Bad"), (3, T0, "Good"),
        ],
    }
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    return Warehouse({n: (lambda f=f: f) for n, f in frames.items()})


def test_step_performance_counts_images_once(wh):
    row = Q.step_performance(wh, dt.datetime(2020, 1, 1)).collect()
    assert [(r.worker_name, r.template_id, r.img_count, r.avg_actual_s, r.efficiency, r.sum_actual_s)
            for r in row] == [("Ann", 10, 2, 2.0, 2.0, 6.0)]


def test_rejections_multiply_the_times_unless_counted_singly(wh):
    out = Q.step_performance(wh, dt.datetime(2020, 1, 1), with_rejections=True).first()
    # Image 1 has two steps and three rejections, image 2 one of each.
    assert (out.rej_count, out.sum_actual_s, out.img_count) == (7, 14.0, 2)
    single = Q.step_performance(
        wh, dt.datetime(2020, 1, 1), with_rejections=True, fan_out=False
    ).first()
    assert (single.rej_count, single.sum_actual_s) == (4, 6.0)


def test_filters_and_keys(wh):
    since = dt.datetime(2020, 1, 1)
    assert Q.step_performance(wh, since, customer_id=2).count() == 0
    assert Q.step_performance(wh, since, template_prefix="Template B").count() == 0
    assert Q.step_performance(wh, since, skill="s121", by_image=True).count() == 2
    local = Q.step_performance(wh, since, clock="local").first()
    assert (str(local.date), local.date_time.hour) == ("2020-05-05", 3)
    assert str(Q.step_performance(wh, since, clock="utc").first().date) == "2020-05-04"
    assert Q.step_performance(wh, dt.datetime(2020, 5, 5, 3)).count() == 0  # strictly after


def test_template_monthly(wh):
    row = Q.template_monthly(wh, dt.datetime(2020, 1, 1), "Template A").first()
    # Steps of images 1 and 2: 3 + 1 on live and unknown templates alike.
    assert (row.month, row.img_count, row.rej_count, row.cust_rej_count) == (5, 2, 2, 2)
    once = Q.template_monthly(wh, dt.datetime(2020, 1, 1), "Template A", fan_out=False).first()
    assert (once.rej_count, once.cust_rej_count, once.rej_rate) == (1, 1, 0.5)


def test_latest_grade_keeps_ties(wh):
    got = {r.image_id for r in Q.latest_grades(wh.mask_quality, "Good", dt.datetime(2020, 1, 1)).collect()}
    assert got == {1, 3}


def test_mask_quality(wh):
    rate = Q.mask_quality_rate(wh.mask_quality, wh.steps, wh.rejections)
    assert [(str(r.date), r.img_count, r.rej_count, r.rej_rate) for r in rate.collect()] == [
        ("2020-05-06", 1, 2, 2.0)
    ]
    every = Q.mask_quality_rate(wh.mask_quality, wh.steps, wh.rejections, rejected_only=False)
    assert {(str(r.date), r.img_count, r.rej_count) for r in every.collect()} == {
        ("2020-05-06", 1, 2), ("2020-05-05", 1, 0),
    }


def test_every_step_meets_its_customer_and_template(spark):
    from crewmetrics.sources.adapters import driver_warehouse

    sf = "/root/testdata/sf0.01"
    wh = driver_warehouse(spark, sf)
    steps = wh.steps
    met = steps.join(wh.customers, "customer_id").join(wh.templates, ["customer_id", "template_name"])
    assert steps.count() == met.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() == 60_000
    kinds = {r.template_name for r in met.select("template_name").distinct().collect()}
    assert kinds == {"Template F", "Template O", "Template P"}
    assert set(steps.columns) - set(wh.work_steps.columns) == {"customer_id", "template_name"}
