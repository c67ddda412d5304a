"""The source relations as seen in the driver's TPC-H-like tables.

Every adapter reads its whole table. Workers are the customers; events and lines name them
through ``user_id`` and ``l_suppkey`` in blocks of ten, which keeps the rows per worker
about the same at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crewmetrics.sources.schemas import Warehouse

# --- Fixed values of the adapters ---------------------------------------------

DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
    "value double, props string",
}
OFFICE_ID = """case {key} when 0 then 4 when 1 then 2 when 2 then 3 when 3 then 8 when 4 then 5
 end as office_id"""
OFFICE_NAME = """case {key} when 0 then 'Delta Office' when 1 then 'Metro Office'
 when 2 then 'Borough Office' when 3 then 'Canal Office' when 4 then 'Dock Office'
 end as office_name"""
WORKER_OFFICE = "c_nationkey div 5"
NAME_PREFIX = """case c_nationkey when 3 then 'robot ' when 5 then 'auto ' when 12 then 'demo '
 when 13 then 'Test ' when 17 then 'Crew Bot ' when 21 then 'Freelance ' else '' end"""
SKILL_ID = """case p_type when 'ECONOMY' then 121 when 'LARGE' then 5 when 'MEDIUM' then 43
 when 'PROMO' then 10 when 'SMALL' then 22 when 'STANDARD' then 600 end as skill_id"""
SKILL_ORDER = """case p_type when 'ECONOMY' then 3 when 'LARGE' then 1 when 'MEDIUM' then 6
 when 'PROMO' then 2 when 'SMALL' then 5 when 'STANDARD' then 4 end as sort_order"""
ACTIVITY_TYPE = """case
 when event_type = 'view' then case k % 4 when 0 then 7 when 1 then 0 when 2 then 14 else 3 end
 when event_type = 'click' then case k % 6 when 0 then 12 when 1 then 10 when 2 then 5
   when 3 then 9 when 4 then 0 else 11 end
 when k >= 70 then 12 end as activity_type_id"""
APPLICATION = """case whole % 11 when 0 then 'Adobe Photoshop CC' when 1 then 'Google Chrome'
 when 2 then 'Skype for Business' when 3 then 'IDLE' when 4 then 'Windows Explorer'
 when 5 then 'Firefox' when 6 then 'smoothXpath' when 7 then 'Notepad++'
 when 8 then 'Brave Browser' when 9 then 'Solitaire' end as application_name"""
LOGOUT_REASON = "case k % 4 when 0 then 1 when 1 then 6 when 2 then 7 end as reason_id"


def driver_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in DRIVER_TABLES]


def driver_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """All relations over the parquet tables of one scale factor."""

    def table(name: str) -> DataFrame:
        # A declared schema spares the job that reads footers to infer one.
        return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    def workers() -> DataFrame:
        return table("customer").selectExpr(
            "c_custkey as worker_id",
            f"concat({NAME_PREFIX}, c_name) as worker_name",
            OFFICE_ID.format(key=WORKER_OFFICE),
            "c_nationkey as planning_group_id",
            "case when c_mktsegment = 'HOUSEHOLD' then 1 when c_mktsegment <> 'BUILDING' "
            "then 0 end as is_locked",
            "concat('E', c_custkey) as employee_code",
            "concat('w', c_custkey, '@example.com') as email",
            OFFICE_NAME.format(key=WORKER_OFFICE),
            "date_add(date '2015-01-01', c_nationkey * 30) as joined_date",
        )

    def worker_roles() -> DataFrame:
        held = """array_compact(array(
          case c_mktsegment when 'BUILDING' then 33 when 'MACHINERY' then 5 else 3 end,
          case when c_mktsegment = 'FURNITURE' then 8 end,
          case when c_acctbal > 4000 then 9 end))"""
        return table("customer").selectExpr(
            "c_custkey as worker_id", f"explode({held}) as role_id"
        )

    def offices() -> DataFrame:
        return table("region").selectExpr(
            OFFICE_ID.format(key="r_regionkey"), OFFICE_NAME.format(key="r_regionkey")
        )

    def events(*kinds: str) -> DataFrame:
        listed = ", ".join(f"'{k}'" for k in kinds)
        return (
            table("events")
            .filter(f"event_type in ({listed})")
            .selectExpr(
                "event_id",
                "ts",
                "event_type",
                "value",
                "user_id div 10 as worker_id",
                "user_id div 100 as leader_id",
                "cast(regexp_extract(props, '[0-9]+', 0) as int) as k",
                "floor(value) as whole",
            )
        )

    def activity_log() -> DataFrame:
        return events("view", "click", "error").selectExpr(
            "event_id",
            "worker_id",
            "case when k % 3 = 0 then event_id when k % 3 = 1 then 0 end as image_id",
            "k % 2 as login_type_id",
            ACTIVITY_TYPE,
            APPLICATION,
            "floor(value * 1000) as runtime_ms",
            "ts as time_at",
        )

    def logout_requests() -> DataFrame:
        return events("signup").selectExpr(
            "event_id", "worker_id", "ts as requested_at", LOGOUT_REASON
        )

    def meals() -> DataFrame:
        return events("purchase").selectExpr(
            "event_id", "worker_id", "ts as start_at", "ts + whole * interval '1' minute as finish_at"
        )

    def shift_reports() -> DataFrame:
        # A report per end-of-shift logout, stamped with the local start of that shift.
        return (
            events("signup")
            .selectExpr("*", LOGOUT_REASON, "ts + interval '45' minute as clock")
            .filter("reason_id = 6")
            .selectExpr(
                "worker_id",
                "leader_id",
                "cast(to_date(clock) as timestamp_ntz) "
                "+ (hour(clock) div 8 * 480 + 375) * interval '1' minute as shift_start_local",
            )
        )

    def skills() -> DataFrame:
        return (
            table("part")
            .select("p_type")
            .distinct()
            .selectExpr(
                SKILL_ID,
                "p_type as skill_name",
                "case when p_type = 'STANDARD' then 1 else 0 end as skill_kind_id",
                SKILL_ORDER,
            )
        )

    def lines() -> DataFrame:
        skill = table("part").selectExpr("p_partkey as l_partkey", SKILL_ID, "p_type as skill_name")
        return table("lineitem").join(skill, "l_partkey").selectExpr(
            "*",
            "l_suppkey div 10 as worker_id",
            "l_shipdate + l_linenumber * interval '5' hour as assign_at",
        )

    def work_steps() -> DataFrame:
        # One step in 17 has no actual time.
        actual = "floor(l_extendedprice * (1 - l_discount) * (1 + l_tax))"
        return (
            lines()
            .selectExpr("*", f"case when (l_orderkey + l_partkey) % 17 <> 0 then {actual} end as actual_ms")
            .selectExpr(
                "l_orderkey as image_id",
                "l_linenumber as line_no",
                "l_partkey as part_id",
                "skill_id",
                "skill_name",
                "worker_id",
                "assign_at",
                "actual_ms div 1000 as actual_s",
                "actual_ms",
                "floor(l_quantity * 1000) as expected_ms",
            )
        )

    def steps() -> DataFrame:
        # Each image is an order, of one customer and one template kind.
        ordered = table("orders").selectExpr(
            "o_orderkey as image_id",
            "o_custkey as customer_id",
            "concat('Template ', o_orderstatus) as template_name",
        )
        return work_steps().join(ordered, "image_id", "left")

    def rejections() -> DataFrame:
        return (
            lines()
            .filter("l_returnflag = 'R'")
            .selectExpr(
                "l_orderkey as image_id",
                "skill_id",
                "case when l_partkey % 11 <> 0 then worker_id end as receiver_id",
                "assign_at + cast(l_quantity as int) % 9 * interval '1' day as rejected_at",
                "case l_linenumber % 3 when 0 then 1 when 1 then 0 end as is_customer",
            )
        )

    def images() -> DataFrame:
        return table("orders").selectExpr("o_orderkey as image_id")

    def customers() -> DataFrame:
        return table("customer").selectExpr("c_custkey as customer_id", "c_name as company")

    def templates() -> DataFrame:
        return (
            table("customer")
            .selectExpr("c_custkey", "c_acctbal", "posexplode(array('F', 'O', 'P')) as (pos, kind)")
            .selectExpr(
                "c_custkey * 3 + pos as template_id",
                "concat('Template ', kind) as template_name",
                "c_custkey as customer_id",
                "case when c_acctbal < 0 and kind = 'P' then 1 else 0 end as is_deleted",
            )
        )

    def work_reports() -> DataFrame:
        return lines().selectExpr(
            "l_orderkey as image_id",
            "skill_id",
            "worker_id",
            "l_shipdate as created_at",
            "case when l_quantity >= 3 then 10 else 5 end as status_id",
        )

    def mask_quality() -> DataFrame:
        return table("lineitem").selectExpr(
            "l_orderkey as image_id",
            "l_shipdate as created_at",
            "case when l_returnflag = 'N' then 'Bad' else 'Good' end as grade",
        )

    return Warehouse(
        {
            "workers": workers,
            "worker_roles": worker_roles,
            "offices": offices,
            "activity_log": activity_log,
            "logout_requests": logout_requests,
            "meals": meals,
            "shift_reports": shift_reports,
            "skills": skills,
            "steps": steps,
            "work_steps": work_steps,
            "rejections": rejections,
            "images": images,
            "customers": customers,
            "templates": templates,
            "work_reports": work_reports,
            "mask_quality": mask_quality,
        }
    )
