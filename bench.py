"""Times the headline queries on a stored history and prints one JSON line.

The task view of $BENCH_SF_DIR is priced and added to an empty history first (timed as
``append``), then added again (``append_again``, which must add nothing). The other queries read
that history, as a user's queries do. Everything is run once untimed and then timed."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.operators import anomalies as A
from meterlake.operators import compare as C
from meterlake.operators import filters as FL
from meterlake.operators import lookup as L
from meterlake.operators import month as M
from meterlake.operators import series as D
from meterlake.operators import stats as S
from meterlake.operators.dedup import full_row_duplicates
from meterlake.operators.filters import TaskFilter
from meterlake.operators.ingest import price
from meterlake.plans.views import tasks_tpch
from meterlake.sources import history

FULL = ("1995-01-01", "2001-12-31")
NOW = dt.datetime(2024, 7, 1)
ALL = TaskFilter(*FULL)
MONTH = M.Month.of("1998-12-01", "1998-12-18")

QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "org_stats": lambda t: S.org_stats(t, ALL),
    "daily_stats": lambda t: S.daily_stats(t, ALL),
    "org_daily": lambda t: S.org_daily_stats(t, ALL),
    "task_top": lambda t: S.top_tasks(t, ALL),
    "env_stats": lambda t: S.environment_stats(t, ALL),
    "summary_by_project": lambda t: S.summary_by(t, "project_name"),
    "describe_numeric": lambda t: S.describe_numeric(t),
    "duration_stats": lambda t: S.duration_stats(t),
    "lookup_rows": lambda t: L.lookup_rows(t, ALL, "ring", "low"),
    "coverage_gaps": lambda t: D.coverage_gaps(t, *FULL),
    "cumulative_org": lambda t: D.cumulative_by_org(t, *FULL),
    "anomalies": lambda t: A.daily_anomalies(t, *FULL),
    "task_spikes": lambda t: A.task_spikes(t, "1999-12-31", 90, 90, 1.5),
    "month_metrics": lambda t: M.month_metrics(t, MONTH, 45000.0),
    "what_if": lambda t: M.what_if(t, MONTH, 45000.0),
    "period_compare": lambda t: C.period_compare(t, C.report_periods("1999-03-31")),
    "task_changes": lambda t: C.task_changes(t, C.report_periods("1999-03-31")),
    "full_row_duplicates": lambda t: full_row_duplicates(t.drop("batch_id", "created_at")),
    "count_in_range": lambda t: FL.count_in_range(t, TaskFilter("1998-01-01", "1998-12-31")),
}


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def timed(action: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    result = action()
    return round(time.perf_counter() - began, 3), result


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    root = tempfile.mkdtemp(prefix="run-bench-")
    # the tables are one file with one row group each; a real batch arrives in many files
    batch = price(tasks_tpch(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))
    history.append_tasks(spark, tempfile.mkdtemp(prefix="run-bench-"), batch, NOW)
    seconds: dict[str, float] = {}
    seconds["append"], added = timed(lambda: history.append_tasks(spark, root, batch, NOW))
    seconds["append_again"], again = timed(lambda: history.append_tasks(spark, root, batch, NOW))
    assert added.rows_added == added.total_rows == again.total_rows and again.rows_added == 0
    tasks = history.read_history(spark, root)
    for name, query in QUERIES.items():
        run(query(tasks))
        seconds[name], _ = timed(lambda: run(query(tasks)))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "rows": added.total_rows,
    }))


if __name__ == "__main__":
    main()
