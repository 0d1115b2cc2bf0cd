"""Daily cells: task rows summed per day and every reported dimension.

A report that looks at the same window from many sides reads the rows once, into cells, and works
on those; the operators take cells in place of task rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.pricing import WEIGHT, usage
from meterlake.operators.filters import Day, in_days
from meterlake.schema import Pricing
from meterlake.sources.files import work_dir, writing

CELL_KEYS = ["end_date", "log_type", "org", "environment", "project_name", "task_name", "task_id"]


def daily_cells(tasks: DataFrame, start: Day, end: Day, pricing: Pricing = Pricing()) -> DataFrame:
    used = usage(tasks, pricing)
    sums = tasks.where(in_days(tasks, start, end)).groupBy(*CELL_KEYS).agg(
        used.total(used.ipus).alias("ipus"), used.total(used.cost).alias("cost"), used.runs().alias(WEIGHT)
    )
    return sums.withColumn("end_time", F.col("end_date").cast("timestamp"))


def kept(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Writes a frame that is used many times to the shared work folder, or to ``path``, and reads it back."""
    path = path or work_dir(df.sparkSession, purpose)
    with writing(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
