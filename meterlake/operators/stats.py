"""Grouped totals over task rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.cells import number_or_zero
from meterlake.functions.labels import env_base, label, log_type_label, org_label
from meterlake.functions.pricing import exact_sum, minutes_between, shown, usage
from meterlake.operators.filters import Day, TaskFilter, as_date, in_days, sliced
from meterlake.operators.quantiles import exact_quantiles, long_form
from meterlake.schema import Pricing

def day_key() -> Column:
    return F.col("end_date").alias("date")


def totals(df: DataFrame, keys: Sequence[Column], pricing: Pricing, unique: bool = False) -> DataFrame:
    """Row count and exact unit and cost totals per key, all partially aggregated before the
    shuffle. ``unique`` adds the number of distinct task ids."""
    used = usage(df, pricing)
    measures = [
        used.runs().alias("task_count"),
        used.total(used.ipus).alias("total_ipus"),
        used.total(used.cost).alias("total_cost"),
    ]
    if unique:
        measures.append(F.countDistinct("task_id").alias("unique_tasks"))
    return df.groupBy(*keys).agg(*measures)


def finish(df: DataFrame) -> DataFrame:
    return df.withColumns({c: shown(F.col(c)) for c in ("total_ipus", "total_cost")})


def stats(df: DataFrame, keys: Sequence[Column], pricing: Pricing, unique: bool = False) -> DataFrame:
    return finish(totals(df, keys, pricing, unique))


def by_usage(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(F.desc("total_ipus"), *keys)


# --- totals over the history, by dimension ------------------------------------------------

def daily_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return stats(f.apply(tasks), [day_key()], pricing).orderBy("date")


def org_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return by_usage(stats(f.apply(tasks), [org_label().alias("org")], pricing, unique=True), "org")


def org_daily_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return stats(f.apply(tasks), [day_key(), org_label().alias("org")], pricing).orderBy("date", "org")


def project_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return by_usage(stats(f.apply(tasks), [F.col("project_name")], pricing, unique=True), "project_name")


def task_keys() -> list[Column]:
    return [
        org_label().alias("org"),
        label(F.col("project_name"), "-").alias("project_name"),
        label(F.col("task_name"), "(Unnamed)").alias("task_name"),
    ]


def top_tasks(tasks: DataFrame, f: TaskFilter, limit: int | None = 25, pricing: Pricing = Pricing()) -> DataFrame:
    ranked = by_usage(stats(f.apply(tasks), task_keys(), pricing), "org", "project_name", "task_name")
    return ranked.limit(limit) if limit else ranked


def filtered_daily_stats(
    tasks: DataFrame,
    start: Day,
    end: Day,
    org: str | None = None,
    orgs: Sequence[str] | None = None,
    project: str | None = None,
    task_name: str | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    rows = sliced(tasks, start, end, org, orgs, project, task_name, log_type)
    return stats(rows, [day_key()], pricing).orderBy("date")


def environment_stats(
    tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing(), exact_unique: bool = False
) -> DataFrame:
    """Totals per base environment. unique_tasks adds up the distinct ids of each full
    environment name, unless ``exact_unique`` asks for one count per base."""
    base = env_base(F.col("environment")).alias("environment")
    if exact_unique:
        return by_usage(stats(f.apply(tasks), [base], pricing, unique=True), "environment")
    per_name = totals(f.apply(tasks), [F.col("environment")], pricing, unique=True)
    per_base = per_name.groupBy(base).agg(
        *[F.sum(c).alias(c) for c in ("task_count", "total_ipus", "total_cost", "unique_tasks")]
    )
    return by_usage(finish(per_base), "environment")


def agent_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return by_usage(stats(f.apply(tasks), [F.col("agent_name")], pricing, unique=True), "agent_name")


def log_type_stats(tasks: DataFrame, start: Day, end: Day, pricing: Pricing = Pricing()) -> DataFrame:
    """Always over both log types."""
    rows = tasks.where(in_days(tasks, start, end))
    return by_usage(stats(rows, [log_type_label().alias("log_type")], pricing, unique=True), "log_type")


def log_type_daily_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return stats(f.apply(tasks), [day_key(), log_type_label().alias("log_type")], pricing).orderBy("date", "log_type")


def task_type_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return by_usage(stats(f.apply(tasks), [F.col("task_type")], pricing, unique=True), "task_type")


def status_stats(tasks: DataFrame, f: TaskFilter, pricing: Pricing = Pricing()) -> DataFrame:
    return by_usage(stats(f.apply(tasks), [F.col("status")], pricing), "status")


def history_range(tasks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """First and last end time that is at least one day old."""
    cutoff = as_of - dt.timedelta(days=1)
    old = tasks.where(F.col("end_time") <= F.lit(cutoff).cast(tasks.schema["end_time"].dataType))
    if "end_month" in tasks.columns:
        old = old.where(F.col("end_month") <= F.lit(as_date(cutoff.date()).replace(day=1)))
    return old.agg(F.min("end_time").alias("first_end"), F.max("end_time").alias("last_end"))


# --- summaries of a priced batch ----------------------------------------------------------

AMOUNTS = {"ipus": "ipus", "cost": "cost", "cores_used": "cores"}


def present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def summary_by(df: DataFrame, *keys: str) -> DataFrame:
    """Runs plus sum and mean of units, cost and cores; rows without a key are left out."""
    measures = [F.count("task_run_id").alias("task_count")]
    for column, name in AMOUNTS.items():
        total = exact_sum(number_or_zero(F.col(column)))
        measures += [
            shown(total).alias(f"total_{name}"),
            F.round(total.cast("double") / F.count(F.lit(1)), 6).alias(f"avg_{name}"),
        ]
    return present(df, keys).groupBy(*keys).agg(*measures).orderBy(*keys)


def pivot_summary(df: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("org",)
    return present(df, keys).groupBy(*keys).agg(*_amounts()).orderBy(*keys)


def _amounts() -> list[Column]:
    return [
        shown(exact_sum(number_or_zero(F.col("ipus")))).alias("total_ipus"),
        shown(exact_sum(number_or_zero(F.col("cost")))).alias("total_cost"),
    ]


def _runs() -> Column:
    return F.count("task_run_id").alias("run_count")


def project_folder_summary(df: DataFrame) -> DataFrame:
    keys = ("project_name", "folder_name")
    rows = present(df, keys).groupBy(*keys).agg(_runs(), *_amounts(), F.countDistinct("task_id").alias("unique_tasks"))
    return by_usage(rows, *keys)


def status_counts(df: DataFrame) -> DataFrame:
    rows = present(df, ["status"]).groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.orderBy(F.desc("row_count"), "status")


def headline(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), *_amounts(), F.countDistinct("task_run_id").alias("unique_runs")
    )


def status_headline(df: DataFrame, status: str) -> DataFrame:
    rows = df.where(F.col("status") == status)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), *_amounts(), F.countDistinct("task_id").alias("unique_tasks"))


def status_top_tasks(df: DataFrame, status: str, limit: int = 10) -> DataFrame:
    keys = ("task_id", "task_name", "project_name", "folder_name")
    rows = present(df.where(F.col("status") == status), keys).groupBy(*keys).agg(_runs(), *_amounts())
    return by_usage(rows, *keys).limit(limit)


def batch_daily(df: DataFrame, *extra: str) -> DataFrame:
    """Runs, units and cost per day, optionally by organization or log type."""
    rows = present(df, ["end_time", *extra])
    return rows.groupBy(F.to_date("end_time").alias("date"), *extra).agg(_runs(), *_amounts()).orderBy("date", *extra)


def batch_hourly(df: DataFrame, *extra: str) -> DataFrame:
    """Runs, units and cost per hour of day over all days."""
    rows = present(df, ["end_time", *extra])
    hour = F.hour("end_time").alias("hour_of_day")
    return rows.groupBy(hour, *extra).agg(_runs(), *_amounts()).orderBy("hour_of_day", *extra)


def batch_by_org(df: DataFrame) -> DataFrame:
    return by_usage(present(df, ["org"]).groupBy("org").agg(_runs(), *_amounts()), "org")


def log_type_counts(df: DataFrame) -> DataFrame:
    rows = present(df, ["log_type"]).groupBy("log_type").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.orderBy(F.desc("row_count"), "log_type")


def wide(rows: DataFrame, index: str, columns: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """Long totals to one column per name. Give ``names`` to spare Spark the pass that finds them."""
    grouped = rows.groupBy(index)
    pivoted = grouped.pivot(columns, list(names)) if names else grouped.pivot(columns)
    return pivoted.agg(F.sum(value)).orderBy(index)


def duration_stats(df: DataFrame) -> DataFrame:
    """Mean, extremes, exact median and total of run minutes; a run without both times counts 0."""
    minutes = df.select(F.abs(F.coalesce(minutes_between(F.col("start_time"), F.col("end_time")), F.lit(0.0))).alias("minutes"))
    whole = minutes.agg(
        F.count(F.lit(1)).alias("task_count"),
        F.max("minutes").alias("max_minutes"),
        F.min("minutes").alias("min_minutes"),
        exact_sum(F.col("minutes")).alias("sum_minutes"),
    )
    median = exact_quantiles(minutes, ["minutes"], [0.5])
    return whole.select(
        "task_count",
        F.round(F.col("sum_minutes").cast("double") / F.col("task_count"), 6).alias("mean_minutes"),
        F.round("max_minutes", 6).alias("max_minutes"),
        F.round("min_minutes", 6).alias("min_minutes"),
        F.round(median.select("q50").scalar(), 6).alias("median_minutes"),
        shown(F.col("sum_minutes")).alias("total_minutes"),
    )


NUMERIC = ("ipus", "cost", "metered_value", "cores_used")


def describe_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each numeric column, at 2 places."""
    long = long_form(df, columns)
    basics = long.groupBy("metric").agg(
        F.count("value").alias("value_count"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    measures = ["mean_value", "std_value", "min_value", "q25", "q50", "q75", "max_value"]
    rows = basics.join(quartiles, "metric", "left")
    return rows.select("metric", "value_count", *[F.bround(c, 2).alias(c) for c in measures]).orderBy("metric")

