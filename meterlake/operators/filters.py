"""Row filters over task rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.labels import log_type_label
from meterlake.schema import TASK

MISSING_CHOICE = "(Missing)"
NO_PROJECT = ("-", "(No project)", "")  # fixed values

Day = dt.date | str


def as_date(day: Day) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def in_days(df: DataFrame, start: Day, end: Day) -> Column:
    """Inclusive days of end_time. The bound is on the stored timestamp so that the scan can push
    it down, and on the partition column where the table has one."""
    first, last = as_date(start), as_date(end)
    kind = df.schema["end_time"].dataType  # a literal of another timestamp type would wrap the column in a cast
    hit = (F.col("end_time") >= F.lit(first).cast(kind)) & (F.col("end_time") < F.lit(last + dt.timedelta(days=1)).cast(kind))
    if "end_month" in df.columns:
        hit = hit & F.col("end_month").between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))
    return hit


def log_type_is(log_type: str) -> Column:
    """Rows of one log type; an unset log type counts as task usage."""
    if log_type == TASK:
        return log_type_label() == TASK
    return F.col("log_type") == log_type


@dataclass(frozen=True)
class TaskFilter:
    """Date window plus optional dimensions; an unset dimension does not filter."""

    start: Day
    end: Day
    org: str | None = None
    project: str | None = None
    environment: str | None = None
    task_type: str | None = None
    agent: str | None = None
    status: str | None = None
    log_type: str | None = None

    def predicate(self, df: DataFrame) -> Column:
        hit = in_days(df, self.start, self.end)
        exact = {
            "org": self.org,
            "project_name": self.project,
            "environment": self.environment,
            "task_type": self.task_type,
            "agent_name": self.agent,
            "status": self.status,
        }
        for name, value in exact.items():
            if value:
                hit = hit & (F.col(name) == value)
        if self.log_type:
            hit = hit & log_type_is(self.log_type)
        return hit

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))


def tasks_in_range(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    """Matching rows in end-time order."""
    return f.apply(tasks).orderBy("end_time", "task_run_id")


def count_in_range(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    return f.apply(tasks).agg(F.count(F.lit(1)).alias("task_count"))


def choose(df: DataFrame, choices: Mapping[str, Sequence[str]], task_name: str | None = None) -> DataFrame:
    """Multi-select filters. An empty selection keeps all rows; "(Missing)" selects NULLs."""
    for name, values in choices.items():
        if not values:
            continue
        hit = F.col(name).isin([v for v in values if v != MISSING_CHOICE])
        if MISSING_CHOICE in values:
            hit = hit | F.col(name).isNull()
        df = df.where(hit)
    if task_name is not None:
        df = df.where(F.col("task_name") == task_name)
    return df


def choice_options(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column, with "(Missing)" last where it holds NULLs."""
    return (
        df.select(F.col(name).cast("string").alias("value"))
        .distinct()
        .select(F.coalesce("value", F.lit(MISSING_CHOICE)).alias("option"), F.col("value").isNull().alias("is_missing"))
        .orderBy("is_missing", "option")
    )


def hours_between(df: DataFrame, start: Day, end: Day, first_hour: int = 0, last_hour: int = 23) -> DataFrame:
    """Rows inside a date range and an hour-of-day range."""
    return df.where(in_days(df, start, end) & F.hour("end_time").between(first_hour, last_hour))


def timestamps_between(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows between two exact timestamps, both inclusive."""
    kind = df.schema["end_time"].dataType
    hit = F.col("end_time").between(F.lit(start).cast(kind), F.lit(end).cast(kind)) & in_days(df, start.date(), end.date())
    return df.where(hit).orderBy("end_time", "task_run_id")


def project_is(project: str) -> Column:
    """A project by name; any spelling of "no project" selects all rows without one."""
    if project.strip() in NO_PROJECT:
        return F.trim(F.coalesce("project_name", F.lit(""))).isin(list(NO_PROJECT))
    return F.col("project_name") == project


def sliced(
    tasks: DataFrame,
    start: Day,
    end: Day,
    org: str | None = None,
    orgs: Sequence[str] | None = None,
    project: str | None = None,
    task_name: str | None = None,
    log_type: str | None = None,
) -> DataFrame:
    """Organization / project / task slice of a window; ``org`` wins over ``orgs``."""
    hit = in_days(tasks, start, end)
    if org:
        hit = hit & (F.col("org") == org)
    elif orgs:
        hit = hit & F.col("org").isin(list(orgs))
    if project is not None:
        hit = hit & project_is(project)
    if task_name is not None:
        hit = hit & (F.col("task_name") == task_name)
    if log_type:
        hit = hit & log_type_is(log_type)
    return tasks.where(hit)


def term_matches(query: str, folder: str | None = None, mode: str = "contains", literal: bool = False) -> Column | None:
    """Search over object name and task name (and folder), ignoring case and outer blanks. In
    "contains" mode % and _ are wildcards unless ``literal``."""

    def matches(name: str, text: str) -> Column:
        cell = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
        if mode == "exact":
            return cell == text
        if literal:
            return cell.contains(text)
        return cell.like(f"%{text}%")

    hit = None
    text = (query or "").strip().lower()
    if text:
        hit = matches("task_object_name", text) | matches("task_name", text)
    text = (folder or "").strip().lower()
    if text:
        in_folder = matches("folder_name", text)
        hit = in_folder if hit is None else hit & in_folder
    return hit


def analysis_end(end: Day, as_of: Day) -> dt.date:
    """Last whole day: the day before ``as_of`` at the latest."""
    return min(as_date(end), as_date(as_of) - dt.timedelta(days=1))
