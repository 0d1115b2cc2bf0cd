"""Per-run snapshots: totals of one import, kept for comparing imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import label, org_label
from meterlake.functions.pricing import exact_sum, usage
from meterlake.operators.anomalies import outliers
from meterlake.operators.cells import kept
from meterlake.operators.stats import finish, totals
from meterlake.schema import Pricing
from meterlake.sources import files


def run_headers(rows: DataFrame, pricing: Pricing = Pricing()) -> DataFrame:
    """One row per run_id of the frame, which also carries run_name, run_timestamp and
    source_files."""
    keys = [*map(F.col, ("run_id", "run_name", "run_timestamp", "source_files"))]
    sums = finish(totals(rows.withColumn("task_id", F.col("task_run_id")), keys, pricing, unique=True))
    return _header_columns(sums, pricing)


def _header_columns(sums: DataFrame, pricing: Pricing) -> DataFrame:
    return sums.select(
        "run_id", "run_name", "run_timestamp", "source_files",
        F.lit(pricing.task_factor).alias("ipu_conversion_factor"),
        F.lit(pricing.unit_cost).alias("cost_per_ipu_month"),
        F.col("task_count").alias("total_rows"), "total_ipus", "total_cost",
        F.col("unique_tasks").alias("unique_task_runs"), F.col("task_count").alias("row_count"),
    )


def _per_task() -> Column:
    return F.round(F.col("total_ipus") / F.col("task_count"), 6).alias("avg_ipus_per_task")


def _by(rows: DataFrame, key: Column, pricing: Pricing, unique: bool = True) -> DataFrame:
    return finish(totals(rows, [F.col("run_id"), key], pricing, unique=unique))


def run_summaries(rows: DataFrame, pricing: Pricing = Pricing()) -> dict[str, DataFrame]:
    """The summary tables of all runs in the frame."""
    return {
        "org_summaries": _by(rows, org_label().alias("org_name"), pricing).select("*", _per_task()),
        "env_summaries": _by(rows, label(F.col("environment"), "Unknown").alias("environment"), pricing),
        "project_summaries": _by(rows, label(F.col("project_name"), "-").alias("project_name"), pricing),
        "task_type_summaries": _by(rows, label(F.col("task_type"), "Unknown").alias("task_type"), pricing),
        "status_summaries": _by(rows, F.col("status"), pricing, unique=False),
        "daily_stats": _by(rows, F.col("end_date").alias("stat_date"), pricing, unique=False),
    }


# table: its key column, its value, the id that its distinct counts are of
SNAPSHOT = {
    "runs": (None, lambda: F.lit(None), "task_run_id"),
    "org_summaries": ("org_name", org_label, "task_id"),
    "env_summaries": ("environment", lambda: label(F.col("environment"), "Unknown"), "task_id"),
    "project_summaries": ("project_name", lambda: label(F.col("project_name"), "-"), "task_id"),
    "task_type_summaries": ("task_type", lambda: label(F.col("task_type"), "Unknown"), "task_id"),
    "status_summaries": ("status", lambda: F.col("status"), None),
    "daily_stats": ("stat_date", lambda: F.col("end_date"), None),
}
HEADER = ("run_name", "run_timestamp", "source_files")


def run_snapshot(rows: DataFrame, pricing: Pricing = Pricing()) -> dict[str, DataFrame]:
    """The header and all summary tables of the frame's runs by one scan of it: what they read of the
    rows is written once, and every row counts once for each table. Ids are counted apart from the
    sums, so that only keys and ids are shuffled for them and the sums are few rows before they are.
    The sums are written once, and the tables are read from there."""
    used = usage(rows, pricing)
    spark, staging = rows.sparkSession, files.work_dir(rows.sparkSession, "run-rows")
    values = [value().cast("string").alias(f"_{name}") for name, (_, value, _) in SNAPSHOT.items() if name != "runs"]
    ids = [F.col(c).cast("string").alias(f"_{c}") for c in sorted({of for _, _, of in SNAPSHOT.values() if of})]
    staged = kept(rows.select("run_id", F.struct(*HEADER).alias("_h"), used.ipus.alias("ipus"), used.cost.alias("cost"), *values, *ids), "run-rows", staging)
    no_header = F.lit(None).cast(staged.schema["_h"].dataType)

    def part(name: str, of: str | None = None) -> Column:
        value, header = (F.lit(None).cast("string"), F.col("_h")) if name == "runs" else (F.col(f"_{name}"), no_header)
        key = [F.lit(name).alias("_table"), value.alias("_value"), header.alias("_header")]
        return F.struct(*key, F.col(f"_{of}").alias("task_id")) if of else F.struct(*key)

    keys = ["run_id", "_table", "_value", "_header"]
    sums = staged.select("run_id", "ipus", "cost", F.inline(F.array(*[part(name) for name in SNAPSHOT]))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("task_count"), exact_sum(F.col("ipus")).alias("total_ipus"), exact_sum(F.col("cost")).alias("total_cost")
    )
    met = staged.select("run_id", F.inline(F.array(*[part(name, of) for name, (_, _, of) in SNAPSHOT.items() if of]))).where("task_id is not null")
    unique = met.groupBy(*keys).agg(F.countDistinct("task_id").alias("unique_tasks"))
    both = sums.unionByName(unique, allowMissingColumns=True).groupBy(*keys).agg(  # one row of either kind for a key
        *[F.max(c).alias(c) for c in ("task_count", "total_ipus", "total_cost")], F.coalesce(F.max("unique_tasks"), F.lit(0).cast("long")).alias("unique_tasks")
    )
    done = kept(finish(both), "run-sums")
    files.remove(spark, staging)
    tables = {}
    for name, (key, _, of) in SNAPSHOT.items():
        table = done.where(F.col("_table") == name)
        if key is None:
            tables[name] = _header_columns(table.select("*", "_header.*"), pricing)
            continue
        value = F.col("_value").cast("date" if key == "stat_date" else "string").alias(key)
        unique = ["unique_tasks"] if of else []
        tables[name] = table.select("run_id", value, "task_count", "total_ipus", "total_cost", *unique)
    tables["org_summaries"] = tables["org_summaries"].select("*", _per_task())
    return tables


def write_runs(rows: DataFrame, root: str, pricing: Pricing = Pricing()) -> None:
    for name, table in run_snapshot(rows, pricing).items():
        table.write.mode("append").partitionBy("run_id").parquet(f"{root}/{name}")


TABLES = tuple(SNAPSHOT)


def read_runs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/{t}").withColumn("run_id", F.col("run_id").cast("string")) for t in TABLES}


def all_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_timestamp"), "run_id")


def run_details(tables: dict[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    of_run = {name: t.where(F.col("run_id") == run_id) for name, t in tables.items()}
    return {
        name: t.orderBy("stat_date") if name == "daily_stats" else t.orderBy(F.desc("total_ipus"))
        for name, t in of_run.items()
    }


def delete_run(spark: SparkSession, root: str, run_id: str) -> bool:
    """Drops a run's partition from every table; tells whether the run was there."""
    there = files.exists(spark, f"{root}/runs/run_id={run_id}")
    for table in (*TABLES[1:], "runs"):
        files.remove(spark, f"{root}/{table}/run_id={run_id}")
    return there


def compare_runs(tables: dict[str, DataFrame], run_ids: Sequence[str]) -> dict[str, DataFrame]:
    chosen = F.col("run_id").isin(list(run_ids))
    amounts = ("total_ipus", "total_cost", "task_count")
    return {
        "runs": tables["runs"].where(chosen).orderBy("run_timestamp", "run_id"),
        "org_comparison": tables["org_summaries"].where(chosen).select("run_id", "org_name", *amounts),
        "env_comparison": tables["env_summaries"].where(chosen).select("run_id", "environment", *amounts),
        "project_comparison": tables["project_summaries"].where(chosen).select("run_id", "project_name", *amounts),
    }


def run_trend(
    tables: dict[str, DataFrame], table: str | None = None, column: str | None = None, value: str | None = None, last: int = 10
) -> DataFrame:
    """Totals of the last runs in time order, overall or for one value of a summary table."""
    recent = tables["runs"].orderBy(F.desc("run_timestamp"), F.desc("run_id")).limit(last)
    if table is None:
        trend = recent.select("run_id", "run_name", "run_timestamp", "total_ipus", "total_cost", "total_rows")
    else:
        sums = tables[table].where(F.col(column) == value).select("run_id", "total_ipus", "total_cost", "task_count")
        trend = recent.select("run_id", "run_name", "run_timestamp").join(sums, "run_id")
    return trend.orderBy("run_timestamp", "run_id")


def run_anomalies(runs: DataFrame, metric: str = "total_ipus", threshold: float = 2.0) -> DataFrame:
    """Runs whose total is unusual; there is one row per import."""
    return outliers(runs.select("run_id", "run_name", "run_timestamp", metric), metric, threshold, skip_flat=False)
