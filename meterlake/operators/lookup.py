"""Task lookup: rows that match a search term, and their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.labels import blank_to_null, label, log_type_label, org_label
from meterlake.functions.pricing import eff_cost, eff_ipus, exact_sum, shown
from meterlake.operators.filters import TaskFilter, term_matches
from meterlake.schema import Pricing


def lookup_rows(
    tasks: DataFrame,
    f: TaskFilter,
    query: str,
    folder: str | None = None,
    mode: str = "contains",
    literal: bool = False,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """Matching rows with labels and effective amounts, newest first. The matched term is the
    object name, else the task name."""
    window = TaskFilter(f.start, f.end, org=f.org, log_type=f.log_type)
    rows = window.apply(tasks)
    hit = term_matches(query, folder, mode, literal)
    if hit is not None:
        rows = rows.where(hit)
    return rows.select(
        "task_run_id",
        F.coalesce(
            blank_to_null(F.col("task_object_name")), blank_to_null(F.col("task_name")), F.lit("(Unnamed)")
        ).alias("matched_task"),
        label(F.col("task_object_name"), "").alias("task_object_name"),
        label(F.col("task_name"), "").alias("task_name"),
        label(F.col("folder_name"), "(No folder)").alias("folder_name"),
        label(F.col("project_name"), "(No project)").alias("project_name"),
        org_label().alias("org"),
        log_type_label().alias("log_type"),
        "end_time",
        eff_ipus(pricing).alias("effective_ipus"),
        eff_cost(pricing).alias("effective_cost"),
        F.coalesce("metered_value", F.lit(0.0)).alias("metered_value"),
    ).orderBy(F.desc("end_time"), F.desc("effective_ipus"), "task_run_id")


def lookup_details(rows: DataFrame) -> DataFrame:
    amounts = ("effective_ipus", "effective_cost", "metered_value")
    return rows.withColumns({c: F.bround(c, 6) for c in amounts})


def _sums(*extra) -> list:
    return [
        F.count("task_run_id").alias("task_runs"),
        shown(exact_sum(F.col("effective_ipus"))).alias("total_ipus"),
        *extra,
    ]


def _cost():
    return shown(exact_sum(F.col("effective_cost"))).alias("total_cost")


def _names(column: str):
    return F.array_sort(F.collect_set(blank_to_null(F.col(column))))


def lookup_terms(rows: DataFrame) -> DataFrame:
    """Distinct matched terms with runs, units and the names seen under each term. Names are
    collected from distinct (term, object, task) combinations, not from rows."""
    cells = rows.groupBy("matched_task", "task_object_name", "task_name").agg(
        F.count("task_run_id").alias("task_runs"), exact_sum(F.col("effective_ipus")).alias("total_ipus")
    )
    return (
        cells.groupBy("matched_task")
        .agg(
            F.sum("task_runs").alias("task_runs"),
            shown(F.sum("total_ipus")).alias("total_ipus"),
            _names("task_object_name").alias("object_names"),
            _names("task_name").alias("task_names"),
        )
        .orderBy(F.desc("total_ipus"), F.desc("task_runs"), "matched_task")
    )


def pick_terms(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    return rows.where(F.col("matched_task").isin(list(terms)))


def lookup_totals(rows: DataFrame) -> DataFrame:
    has_object = F.when(F.trim("task_object_name") != "", 1.0).otherwise(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("run_count"),
        shown(exact_sum(F.col("effective_ipus"))).alias("total_ipus"),
        _cost(),
        F.round(F.avg(has_object) * 100, 6).alias("object_coverage_pct"),
    )


def lookup_by_term(rows: DataFrame) -> DataFrame:
    return rows.groupBy("matched_task").agg(*_sums(_cost())).orderBy(F.desc("total_ipus"), "matched_task")


def lookup_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("end_time").alias("date")).agg(*_sums(_cost())).orderBy("date")


def lookup_by(rows: DataFrame, dimension: str) -> DataFrame:
    """Rollup by organization or project."""
    return rows.groupBy(dimension).agg(*_sums()).orderBy(F.desc("total_ipus"), dimension)
