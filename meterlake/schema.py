"""Table schemas, fixed names and pricing parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The two log types and the organization suffix of bulk logs.
TASK = "Task Usage"
BULK = "Mass Ingestion"
LOG_TYPES = (TASK, BULK)
BULK_SUFFIX = " Mass Ingestion"

# Output column titles in report order, and our column for each.
STANDARD_COLUMNS = {
    "Task ID": "task_id",
    "Task Name": "task_name",
    "Task Object Name": "task_object_name",
    "Task Type": "task_type",
    "Task Run ID": "task_run_id",
    "Agent Name": "agent_name",
    "Project Name": "project_name",
    "Folder Name": "folder_name",
    "Org ID": "org_id",
    "Environment ID": "environment_id",
    "Environment": "environment",
    "Cores Used": "cores_used",
    "Start Time": "start_time",
    "End Time": "end_time",
    "Status": "status",
    "Metered Value": "metered_value",
    "Audit Time": "audit_time",
    "OBM Task Time(s)": "obm_task_time",
    "Org": "org",
    "Log Type": "log_type",
    "Run Date": "run_date",
    "IPUs": "ipus",
    "Cost/IPU/Month": "cost",
}


@dataclass(frozen=True)
class Pricing:
    """Usage units per metered value (by log type) and cost per unit and month."""

    task_factor: float = 0.16
    bulk_factor: float = 0.1
    unit_cost: float = 36.04

    def factor_for(self, log_type: str | None) -> float:
        return self.bulk_factor if log_type == BULK else self.task_factor


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


TASKS_SCHEMA = T.StructType(
    _fields(
        T.StringType(),
        "task_id", "task_name", "task_object_name", "task_type", "task_run_id", "row_hash",
        "agent_name", "project_name", "folder_name", "org", "environment", "status", "log_type",
    )
    + _fields(T.TimestampType(), "start_time", "end_time")
    + _fields(T.DateType(), "end_date")
    + _fields(T.DoubleType(), "ipus", "cost", "metered_value", "cores_used")
    + _fields(T.StringType(), "batch_id")
    + _fields(T.TimestampType(), "created_at")
    + _fields(T.DateType(), "end_month")
)

ORGANIZATIONS_SCHEMA = T.StructType(
    _fields(T.StringType(), "name", "external_id", "parent_name")
    + [
        T.StructField("filename_tokens", T.ArrayType(T.StringType())),
        T.StructField("sort_order", T.IntegerType()),
    ]
)

EVENTS_SCHEMA = T.StructType(
    _fields(T.StringType(), "event_id", "action")
    + _fields(T.DateType(), "start_date", "end_date")
    + _fields(T.LongType(), "affected_rows", "remaining_rows")
    + _fields(T.StringType(), "note")
    + _fields(T.TimestampType(), "created_at")
)

FILE_ERRORS_SCHEMA = T.StructType(_fields(T.StringType(), "file_path", "error") + _fields(T.LongType(), "cells"))
