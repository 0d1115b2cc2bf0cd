"""Task rows derived from the star-schema and event tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.organizations import organizations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over the tasks of a shuffle, for work that costs far more than reading: a
    table may come as one large row group, which is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tasks_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task run per line item. The line items take the columns of the small tables first and those
    of orders, with their places, last, so that they are shuffled while they are narrow and never by
    customer."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")}
    places = (
        t["customer"]
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    rows = (
        t["lineitem"]
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["orders"].join(places, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    flag = F.col("l_returnflag")
    return rows.select(
        F.col("l_partkey").cast("string").alias("task_id"),
        F.col("p_name").alias("task_name"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("obj_"), "p_name")).alias("task_object_name"),
        F.col("p_type").alias("task_type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("task_run_id"),
        F.col("s_name").alias("agent_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None)).when(flag == "R", "-").otherwise(F.col("c_mktsegment")).alias("project_name"),
        F.col("o_orderpriority").alias("folder_name"),
        F.when(F.col("r_name") == "AFRICA", "")
        .when(flag == "R", F.concat("r_name", F.lit(" Mass Ingestion"))).otherwise(F.col("r_name")).alias("org"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat("n_name", F.lit(" - Cloud"))).otherwise(F.col("n_name")).alias("environment"),
        F.col("o_orderstatus").alias("status"),
        F.when(flag == "R", "Mass Ingestion").when(flag == "A", F.lit(None)).otherwise("Task Usage").alias("log_type"),
        F.col("o_orderdate").alias("start_time"),
        F.col("l_shipdate").alias("end_time"),
        F.to_date("l_shipdate").alias("end_date"),
        F.when(F.col("l_linestatus") != "F", F.col("l_quantity") * 0.16).alias("ipus"),
        F.lit(None).cast("double").alias("cost"),
        F.col("l_quantity").alias("metered_value"),
        F.col("p_size").cast("double").alias("cores_used"),
    )


def tasks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task run per event."""
    user, failed = F.col("user_id"), F.col("event_type") == "error"

    def numbered(prefix: str, of: int):
        return F.concat(F.lit(prefix), (user % of).cast("string"))

    return table(spark, sf_dir, "events").select(
        user.cast("string").alias("task_id"),
        F.concat("event_type", F.lit("_"), (user % 10).cast("string")).alias("task_name"),
        F.lit(None).cast("string").alias("task_object_name"),
        F.col("event_type").alias("task_type"),
        F.col("event_id").cast("string").alias("task_run_id"),
        numbered("agent_", 7).alias("agent_name"),
        numbered("project_", 12).alias("project_name"),
        numbered("folder_", 3).alias("folder_name"),
        F.when(failed, F.concat(numbered("org_", 5), F.lit(" Mass Ingestion"))).otherwise(numbered("org_", 5)).alias("org"),
        F.when(F.col("event_id") % 2 == 0, F.concat(numbered("env_", 4), F.lit(" - Cloud"))).otherwise(numbered("env_", 4)).alias("environment"),
        F.when(failed, "Failed").otherwise("Completed").alias("status"),
        F.when(failed, "Mass Ingestion").otherwise("Task Usage").alias("log_type"),
        F.col("ts").alias("start_time"),
        F.col("ts").alias("end_time"),
        F.to_date("ts").alias("end_date"),
        F.lit(None).cast("double").alias("ipus"),
        F.lit(None).cast("double").alias("cost"),
        F.col("value").alias("metered_value"),
        (user % 8).cast("double").alias("cores_used"),
    )


def tpch_organizations(spark: SparkSession) -> DataFrame:
    return organizations(spark, [
        {"name": "EAST", "parent_name": "EAST"},
        {"name": "WEST", "parent_name": "WEST"},
        {"name": "ASIA", "external_id": "2", "parent_name": "EAST", "filename_tokens": ["asia"]},
        {"name": "MIDDLE EAST", "external_id": "4", "parent_name": "EAST", "filename_tokens": ["middleeast", "east"]},
        {"name": "AMERICA", "external_id": "1", "parent_name": "WEST", "filename_tokens": ["america"]},
        {"name": "EUROPE", "external_id": "3", "parent_name": "WEST", "filename_tokens": ["europe", "euro"]},
    ])


def events_organizations(spark: SparkSession) -> DataFrame:
    parents = {"org_0": "org_0", "org_1": "org_0", "org_2": "org_0", "org_3": "org_3", "org_4": "org_3"}
    return organizations(spark, [{"name": n, "parent_name": p} for n, p in parents.items()])
