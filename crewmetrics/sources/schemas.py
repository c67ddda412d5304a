"""Column contracts of the source relations and a reader for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "workers": "worker_id long, worker_name string, office_id int, planning_group_id int, "
    "is_locked int, employee_code string, email string, office_name string, joined_date date",
    "worker_roles": "worker_id long, role_id int",
    "offices": "office_id int, office_name string",
    "activity_log": "event_id long, worker_id long, image_id long, login_type_id int, "
    "activity_type_id int, application_name string, runtime_ms long, time_at timestamp_ntz",
    "logout_requests": "event_id long, worker_id long, requested_at timestamp_ntz, reason_id int",
    "meals": "event_id long, worker_id long, start_at timestamp_ntz, finish_at timestamp_ntz",
    "shift_reports": "worker_id long, leader_id long, shift_start_local timestamp_ntz",
    "skills": "skill_id int, skill_name string, skill_kind_id int, sort_order int",
    "steps": "image_id long, line_no int, part_id long, skill_id int, skill_name string, "
    "worker_id long, assign_at timestamp_ntz, actual_s long, actual_ms long, expected_ms long, "
    "customer_id long, template_name string",
    "rejections": "image_id long, skill_id int, receiver_id long, rejected_at timestamp_ntz, "
    "is_customer int",
    "images": "image_id long",
    "customers": "customer_id long, company string",
    "templates": "template_id long, template_name string, customer_id long, is_deleted int",
    "work_reports": "image_id long, skill_id int, worker_id long, created_at timestamp_ntz, "
    "status_id int",
    "mask_quality": "image_id long, created_at timestamp_ntz, grade string",
}


#: Columns of a step that only reports by customer or template read.
STEP_OWNER = ("customer_id", "template_name")


class Warehouse:
    """The source relations by name; each is a plain DataFrame built on first use.

    ``work_steps`` are the steps without their customer and template, for reports that ask for neither: a
    source that has to join for these two names them apart.
    """

    def __init__(self, builders: dict):
        self._builders = {"work_steps": lambda: self.steps.drop(*STEP_OWNER)} | builders

    def replaced(self, **relations: DataFrame) -> Warehouse:
        """The same relations but for those given."""
        return Warehouse(self._builders | {name: lambda df=df: df for name, df in relations.items()})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        relation = self._builders[name]()
        setattr(self, name, relation)
        return relation


def read_warehouse(spark: SparkSession, root: str) -> Warehouse:
    """Parquet relations under ``root``, read with their declared schema."""

    def reader(name: str):
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")

    return Warehouse({name: reader(name) for name in SCHEMAS})
