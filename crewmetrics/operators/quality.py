"""Customer, template and mask-quality measures.

Facts are first reduced to one row per image and report key, so dimensions and rejections
join small, unique rows and distinct images become plain counts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crewmetrics import config as C
from crewmetrics.functions import numeric as N
from crewmetrics.functions.text import like_none
from crewmetrics.functions.timeops import period_number, rows_since, to_local

IDS = ("skill_id", "worker_id", "customer_id", "template_name")


def _clock(kind: str | None) -> dict[str, Column]:
    """Optional time keys: the assignment time on the UTC or on the local clock."""
    if kind is None:
        return {}
    at = F.col("assign_at") if kind == "utc" else to_local(F.col("assign_at"))
    return {"date": F.to_date(at), "date_time": at}


def images_per_key(
    steps: DataFrame, images: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """One row per known image and key with its steps and times."""
    known = images.select("image_id").distinct()
    return (
        steps.groupBy(*keys, "image_id")
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.sum("actual_ms").alias("actual_ms"),
            F.sum("expected_ms").alias("expected_ms"),
        )
        .join(known, "image_id", "left_semi")
    )


def multiply_by_rejections(per_image: DataFrame, rejections: DataFrame) -> DataFrame:
    """Counts every step once per rejection of its image and skill, as an outer join would."""
    counts = rejections.groupBy("image_id", "skill_id").agg(F.count(F.lit(1)).alias("_n"))
    times = F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    return (
        per_image.join(counts, ["image_id", "skill_id"], "left")
        .withColumn("rejections", F.col("steps") * F.coalesce(F.col("_n"), F.lit(0)))
        .withColumn("steps", F.col("steps") * times)
        .withColumn("actual_ms", F.col("actual_ms") * times)
        .withColumn("expected_ms", F.col("expected_ms") * times)
        .drop("_n")
    )


def add_rejections(per_image: DataFrame, rejections: DataFrame) -> DataFrame:
    """Adds the rejections of the image and skill and leaves the times alone."""
    counts = rejections.groupBy("image_id", "skill_id").agg(F.count(F.lit(1)).alias("rejections"))
    return per_image.join(counts, ["image_id", "skill_id"], "left").fillna(0, ["rejections"])


def step_performance(
    wh,
    since: dt.datetime,
    customer_id: int | None = None,
    template_prefix: str | None = None,
    skill: str | None = None,
    by_image: bool = False,
    clock: str | None = None,
    with_rejections: bool = False,
    fan_out: bool = True,
) -> DataFrame:
    """Images, mean times and efficiency by skill, worker, template and customer."""
    steps = rows_since(wh.steps, "assign_at", since, strict=True)
    if customer_id is not None:
        steps = steps.filter(F.col("customer_id") == customer_id)
    if template_prefix is not None:
        steps = steps.filter(F.col("template_name").startswith(template_prefix))
    if skill is not None:
        steps = steps.filter(F.col("skill_name") == skill)
    times = _clock(clock)
    for name, value in times.items():
        steps = steps.withColumn(name, value)
    per_image = images_per_key(steps, wh.images, [*IDS, *times])
    if with_rejections:
        join = multiply_by_rejections if fan_out else add_rejections
        per_image = join(per_image, wh.rejections)

    if by_image:  # the rows are one per image and key already
        work = per_image.withColumn("img_count", F.lit(1).cast("long"))
        if with_rejections:
            work = work.withColumnRenamed("rejections", "rej_count")
    else:
        extra = [F.sum("rejections").alias("rej_count")] if with_rejections else []
        work = per_image.groupBy(*IDS, *times).agg(
            F.count(F.lit(1)).alias("img_count"),
            F.sum("steps").alias("steps"),
            F.sum("actual_ms").alias("actual_ms"),
            F.sum("expected_ms").alias("expected_ms"),
            *extra,
        )
    skills = wh.skills.filter(
        like_none("skill_name", C.PERFORMANCE_SKILL_BLOCKS)
    ).select("skill_id", "skill_name", "sort_order")
    workers = wh.workers.filter(
        like_none("worker_name", C.PERFORMANCE_NAME_BLOCKS)
    ).select("worker_id", "worker_name", "email", "employee_code", "office_name")
    # The large facts meet templates and customers together, in one join.
    templates = (
        wh.templates.filter(F.col("is_deleted") != 1)
        .select("template_id", "template_name", "customer_id")
        .join(wh.customers, "customer_id")
    )
    seconds = N.MS_PER_SECOND
    return (
        work.join(templates, ["template_name", "customer_id"])
        .join(workers, "worker_id")
        .join(skills, "skill_id")
        .select(
            *times,
            "skill_name",
            "worker_name",
            "email",
            "employee_code",
            "office_name",
            *(["image_id"] if by_image else []),
            "template_name",
            "template_id",
            "company",
            "customer_id",
            "skill_id",
            "sort_order",
            "img_count",
            N.round_half_up(N.ratio(F.col("actual_ms"), F.col("steps") * seconds), 1).alias(
                "avg_actual_s"
            ),
            N.round_half_up(N.ratio(F.col("expected_ms"), F.col("steps") * seconds), 1).alias(
                "avg_expected_s"
            ),
            N.round_half_up(N.ratio(F.col("actual_ms"), F.col("expected_ms")), 2).alias(
                "efficiency"
            ),
            N.round_half_up(N.ratio(F.col("actual_ms"), F.lit(seconds)), 1).alias("sum_actual_s"),
            N.round_half_up(N.ratio(F.col("expected_ms"), F.lit(seconds)), 1).alias(
                "sum_expected_s"
            ),
            *(["rej_count"] if with_rejections else []),
        )
    )


def template_monthly(
    wh, since: dt.datetime, template_prefix: str | None = None, fan_out: bool = True
) -> DataFrame:
    """Images, rejection rates, hours and efficiency per month number and skill."""
    kept = wh.workers.filter(
        like_none("worker_name", C.TEMPLATE_NAME_BLOCKS)
    ).select("worker_id")
    steps = rows_since(wh.steps, "assign_at", since, strict=True).filter(
        (F.col("expected_ms") > 0) & F.expr(like_none("skill_name", C.TEMPLATE_SKILL_BLOCKS))
    )
    if template_prefix is not None:
        steps = steps.filter(F.col("template_name").startswith(template_prefix))
    steps = steps.withColumn("month", period_number(F.col("assign_at"), "month_no_local"))
    skill = ["skill_id", "skill_name"]
    units = images_per_key(steps, wh.images, ["month", *skill, "worker_id"]).join(
        kept, "worker_id", "left_semi"
    )
    per_image = units.groupBy("month", *skill, "image_id").agg(
        F.sum("steps").alias("steps"),
        F.sum("actual_ms").alias("actual_ms"),
        F.sum("expected_ms").alias("expected_ms"),
    )
    # Rejections per image and skill: one entry per month number, split by who rejected.
    internal = F.col("receiver_id").isNotNull() & F.col("is_customer").isNull()
    rejected = (
        wh.rejections.groupBy(
            "image_id", "skill_id", period_number(F.col("rejected_at"), "month_no").alias("month")
        )
        .agg(
            F.count(F.when(internal, 1)).alias("internal"),
            F.count(F.when(F.col("is_customer") == 1, 1)).alias("customer"),
        )
        .filter((F.col("internal") > 0) | (F.col("customer") > 0))
        .groupBy("image_id", "skill_id")
        .agg(F.collect_list(F.struct("month", "internal", "customer")).alias("rejected"))
    )
    joined = per_image.join(rejected, ["image_id", "skill_id"], "left")
    if fan_out:
        joined = joined.withColumn("times", F.col("steps"))
    else:
        first = F.min("month").over(W.partitionBy("image_id", "skill_id"))
        joined = joined.withColumn("times", F.when(F.col("month") == first, 1).otherwise(0))
    # Work counts in the month of assignment, a rejection in the month it was made; as rows
    # of one relation both need a single pass over the steps.
    rows = joined.select(
        *skill,
        F.expr("""inline(concat(
          array(named_struct('month', month, 'images', 1L, 'actual_ms', actual_ms,
            'expected_ms', expected_ms, 'internal', 0L, 'customer', 0L)),
          transform(coalesce(rejected, array()), x -> named_struct('month', x.month,
            'images', 0L, 'actual_ms', 0L, 'expected_ms', 0L,
            'internal', x.internal * times, 'customer', x.customer * times))))"""),
    )
    work = (
        rows.groupBy("month", *skill)
        .agg(
            F.sum("images").alias("img_count"),
            F.sum("actual_ms").alias("actual_ms"),
            F.sum("expected_ms").alias("expected_ms"),
            F.nullif(F.sum("internal"), F.lit(0)).alias("rej_count"),
            F.nullif(F.sum("customer"), F.lit(0)).alias("cust_rej_count"),
        )
        .filter(F.col("img_count") > 0)
    )
    images = F.col("img_count")
    return work.select(
        "month",
        "skill_name",
        "skill_id",
        images,
        "rej_count",
        N.round_half_up(N.ratio(F.col("rej_count"), images), 4).alias("rej_rate"),
        "cust_rej_count",
        N.round_half_up(N.ratio(F.col("cust_rej_count"), images), 6).alias("cust_rej_rate"),
        N.round_half_up(N.hours(F.col("actual_ms")), 2).alias("actual_hours"),
        N.round_half_up(N.hours(F.col("expected_ms")), 2).alias("expected_hours"),
        N.round_half_up(N.ratio(F.col("actual_ms"), F.col("expected_ms")), 2).alias("efficiency"),
    )


def latest_grades(masks: DataFrame, grade: str, since: dt.datetime) -> DataFrame:
    """Images whose latest log has the grade; several logs at that time all count as latest."""
    is_grade = (F.col("grade") == grade).cast("int").alias("hit")
    return (
        rows_since(masks, "created_at", since)
        .groupBy("image_id")
        .agg(F.max(F.struct("created_at", F.coalesce(is_grade, F.lit(0)).alias("hit"))).alias("m"))
        .filter(F.col("m.hit") == 1)
        .select("image_id", F.col("m.created_at").alias("created_at"))
    )


def mask_quality_rate(
    masks: DataFrame,
    steps: DataFrame,
    rejections: DataFrame,
    skill_id: int = C.MASK_SKILL,
    grade: str = C.MASK_GRADE,
    since: dt.datetime = dt.datetime(2019, 5, 24),
    rejected_only: bool = True,
) -> DataFrame:
    """Worker rejections per well-graded image and local day.

    Only images with a rejection row count unless ``rejected_only`` is off.
    """
    assigned = (
        steps.filter((F.col("skill_id") == skill_id) & F.col("worker_id").isNotNull())
        .select("image_id")
        .distinct()
    )
    rejected = (
        rejections.filter(F.col("skill_id") == skill_id)
        .groupBy("image_id")
        .agg(F.count("receiver_id").alias("received"))
    )
    good = latest_grades(masks, grade, since).join(assigned, "image_id", "left_semi")
    return (
        good.join(rejected, "image_id", "inner" if rejected_only else "left")
        .groupBy(F.to_date(to_local(F.col("created_at"))).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("img_count"),
            F.coalesce(F.sum("received"), F.lit(0)).alias("rej_count"),
        )
        .select(
            "date",
            F.lit(grade).alias("grade"),
            N.round_half_up(N.ratio(F.col("rej_count"), F.col("img_count")), 4).alias("rej_rate"),
            "img_count",
            "rej_count",
        )
    )
