"""Check queries: reading raw cells, ingest, row identity, history and the organization catalog.

Raw cells and log files are derived from the tables by Spark, so their number grows with them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterlake.functions import cells as K
from meterlake.operators import dedup, ingest
from meterlake.operators.filters import TaskFilter, analysis_end
from meterlake.operators.stats import stats
from meterlake.plans.registry import BASE, FACTOR, TPCH_PARENT, base, days, register, shown, total
from meterlake.plans.views import dealt, table, tasks_events, tasks_tpch, tpch_organizations
from meterlake.schema import BULK, TASK, Pricing
from meterlake.sources import history, log_files, organizations as O
from meterlake.sources.files import renamed, work_dir
from meterlake.sources.sinks import export_batch, export_between, write_csv

RUN_DATE = dt.date(2024, 7, 1)
NOW = dt.datetime(2024, 7, 1, 8)


# --- cells ---

@register("parse_timestamps", """SELECT l_orderkey, l_linenumber, l_shipdate + to_minutes(CAST(l_partkey % 1440 AS BIGINT)) AS minute_text,
  l_shipdate + to_seconds(CAST(l_partkey % 86400 AS BIGINT)) AS second_text, l_shipdate AS month_first_text,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END AS named_text, date_trunc('day', l_shipdate) AS short_year_text,
  l_shipdate AS compact_text, l_shipdate + to_minutes(CAST(l_partkey % 1440 AS BIGINT)) AS named_minute_text, l_shipdate AS long_name_text,
  l_shipdate + INTERVAL 30 MINUTE AS midnight_text FROM lineitem""")
def parse_timestamps(spark, d):
    t = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"))
    day = F.col("l_shipdate").cast("timestamp")
    minute = F.timestamp_add("MINUTE", F.col("l_partkey") % 1440, day)
    second = F.timestamp_add("SECOND", F.col("l_partkey") % 86400, day)
    is_even = F.col("l_linenumber") % 2 == 0
    raw = t.select(
        "l_orderkey", "l_linenumber",
        F.when(is_even, F.date_format(minute, "d/M/yyyy H:mm")).otherwise(F.date_format(minute, "dd-MM-yyyy hh:mm a")).alias("minute_text"),
        F.when(is_even, F.date_format(second, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(second, "yyyy/M/d'T'H:mm:ss")).alias("second_text"),
        F.when(F.dayofmonth(day) > 12, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "d.M.yyyy")).alias("month_first_text"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(" NaT ")).otherwise(F.date_format(day, "dd-MMM-yyyy")).alias("named_text"),
        F.date_format(day, "dd/MM/yy").alias("short_year_text"),
        F.when(is_even, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy.MM.dd")).alias("compact_text"),
        F.when(is_even, F.date_format(minute, "d MMM yy H:mm")).otherwise(F.date_format(minute, "dd-MMM-yyyy HH:mm:ss.SSS")).alias("named_minute_text"),
        F.regexp_replace(F.date_format(day, "MMM d, yyyy"), "Sep", "Sept").alias("long_name_text"),
        F.date_format(day, "dd/MM/yyyy '00:30 AM'").alias("midnight_text"),
    )
    return K.with_timestamps(raw, {c: F.col(c) for c in raw.columns[2:]})


@register("parse_numbers", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
  ELSE l_extendedprice END AS value, l_linenumber % 6 IN (0, 1) AS missing FROM lineitem""")
def parse_numbers(spark, d):
    price = F.col("l_extendedprice").cast("string")
    kind = F.col("l_linenumber") % 6
    text = (
        F.when(kind == 0, " None ").when(kind == 1, "nan").when(kind == 2, F.concat(price, F.lit("abc")))
        .when(kind == 3, F.concat(F.lit("  "), price, F.lit(" "))).otherwise(price)
    )
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return raw.select("l_orderkey", "l_linenumber", K.number(F.col("text")).alias("value"), K.is_missing(F.col("text")).alias("missing"))


@register("start_times", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN DATE '2024-07-01' + CAST(date_trunc('second', ts) AS TIME)
  ELSE date_trunc('second', ts) END AS start_time FROM events""")
def start_times(spark, d):
    """Clock-only starts take the date of the audit time, else of the end time, else of the import."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 4
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "H:mm:ss")).alias("start"),
        F.when(kind == 1, F.date_format(ts, "dd/MM/yyyy")).when(kind == 2, "nat").alias("audit"),
        F.when(kind == 2, F.date_format(ts, "yyyy-MM-dd 23:59:59")).when(kind == 1, "2001-01-01").alias("end"),
    )
    raw = K.with_timestamps(raw, {"audited": F.col("audit"), "ended": F.col("end")})
    full = K.with_full_start(raw, "start_time", F.col("start"), [F.col("audited"), F.col("ended")], F.lit(RUN_DATE))
    return full.select("event_id", "start_time")


@register("standard_headers", """SELECT CAST(l_orderkey AS VARCHAR) AS task_run_id, CAST(l_partkey AS VARCHAR) AS task_id,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE l_linestatus END AS environment FROM lineitem""")
def standard_headers(spark, d):
    """Two headers for one standard column: the first with a value counts."""
    even = F.col("l_linenumber") % 2 == 0
    raw = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("c0"), F.when(even, F.col("l_returnflag")).alias("c1"),
        F.col("l_linestatus").alias("c2"), F.col("l_partkey").cast("string").alias("c3"),
    )
    cells, _ = ingest.standard_cells(raw, [" Job Name", "Environement ", "RUNTIME ENVIRONMENT", "TaskID"])
    return cells.select(
        F.col("Task Run ID").alias("task_run_id"), F.col("Task ID").alias("task_id"), F.col("Environment").alias("environment")
    )


# --- bulk-ingestion cells ---

@register("bulk_cells", """WITH r AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem)
SELECT concat(l_orderkey, '-', l_linenumber) AS task_run_id,
  CASE WHEN l_partkey % 2 = 0 THEN concat(l_orderkey, '-', l_linenumber) ELSE CAST(l_partkey AS VARCHAR) END AS task_id,
  CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE 'given' END AS task_type,
  CASE WHEN l_linenumber IN (1, 3, 5) THEN concat(day, ' 23:59:59') WHEN l_linenumber IN (2, 6) THEN concat(day, ' 10:00:00') END AS end_time,
  CASE WHEN l_linenumber IN (1, 5) THEN concat(day, ' 00:00:00') END AS start_time,
  CASE WHEN l_linenumber IN (3, 4, 7) THEN 'Running' WHEN l_linenumber = 2 THEN 'Failed' ELSE 'Completed' END AS status,
  CASE WHEN l_linenumber IN (1, 2, 3) THEN l_quantity ELSE l_extendedprice END AS metered_value FROM r""")
def bulk_cells(spark, d):
    n = F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    run = F.concat_ws("-", "l_orderkey", "l_linenumber")
    gone = F.lit(None).cast("string")
    raw = table(spark, d, "lineitem").select(
        run.alias("c0"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit("NA")).otherwise(F.col("l_partkey").cast("string")).alias("c1"),
        F.col("l_returnflag").alias("c2"),
        F.when(n % 3 == 0, "none").otherwise("given").alias("c3"),
        F.when(n.isin(2, 6), F.concat(day, F.lit(" 10:00:00"))).when(n == 1, "nat").otherwise(gone).alias("c4"),
        F.when(n.isin(1, 5), F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(gone).alias("c5"),
        F.when(n == 3, day).otherwise(gone).alias("c6"),
        F.when(n == 2, "Failed").when(n == 6, " ").otherwise(gone).alias("c7"),
        F.when(n == 1, "0").when(n == 2, "none").when(n == 3, gone).otherwise(F.col("l_extendedprice").cast("string")).alias("c8"),
        (F.col("l_quantity") * ingest.BYTES_PER_GB).cast("decimal(38,0)").cast("string").alias("c9"),
    )
    headers = ["Job Name", "Task ID", "Task Name", "Task Type", "End Time", "Date", "Metering Date (UTC)", "Status", "Volume (GBs)",
               "Utilization(Bytes)"]
    filled = ingest.fill_bulk_cells(*ingest.standard_cells(raw, headers))
    titles = {"Task Run ID": "task_run_id", "Task ID": "task_id", "Task Type": "task_type", "End Time": "end_time",
              "Start Time": "start_time", "Status": "status"}
    return filled.select(*[F.col(t).alias(n) for t, n in titles.items()], K.number(F.col("Metered Value")).alias("metered_value"))


# --- whole pipeline over files ---

RAW_FILES = "*.csv.gz"


def write_raw_files(spark, d, folder: str) -> None:
    """The task view as gzipped log files of three shapes: two header spellings of task logs, one of bulk logs."""
    t = tasks_tpch(spark, d).withColumns({"s": F.col("start_time").cast("timestamp"), "e": F.col("end_time").cast("timestamp")})
    bulk, even = F.col("log_type") == BULK, F.col("task_id").cast("long") % 2 == 0
    plain = t.where(~F.coalesce(bulk, F.lit(False)))
    write_csv(plain.where(even).select(
        F.col("task_id").alias(" taskid "), F.col("task_name").alias("Task Name"), F.col("task_object_name").alias("task object name"),
        F.col("task_type").alias("tasktype"), F.col("task_run_id").alias("TaskRunID"), F.col("project_name").alias("Project Name"),
        F.col("folder_name").alias("Folder Name"), F.col("environment").alias("Environement"), F.col("cores_used").alias("Cores Used"),
        F.date_format("s", "d/M/yyyy H:mm").alias("Start Time"), F.date_format("e", "yyyy-MM-dd HH:mm:ss").alias("End Time"),
        F.col("status").alias("Status"), F.col("metered_value").alias("Metered Value"), F.col("agent_name").alias("Agent Name"),
    ), f"{folder}/even_tasks", compression="gzip")
    write_csv(plain.where(~even).select(
        F.col("metered_value").alias("MeteredValue"), F.date_format("e", "yyyy/MM/dd").alias("EndTime"), F.date_format("s", "HH:mm:ss").alias("StartTime"),
        F.date_format("s", "dd-MM-yyyy HH:mm").alias("AuditTime"), F.col("task_run_id").alias("Task Run ID"), F.col("task_id").alias("Task ID"),
        F.col("task_name").alias("TaskName"), F.col("task_object_name").alias("TaskObjectName"), F.col("task_type").alias("Task Type"),
        F.col("project_name").alias("ProjectName"), F.col("folder_name").alias("FolderName"), F.col("environment").alias("Environment"),
        F.col("cores_used").alias("CoresUsed"), F.col("status").alias("Status"), F.col("agent_name").alias("Agent Name"),
    ), f"{folder}/odd_tasks", compression="gzip")
    write_csv(t.where(bulk).select(
        F.col("task_run_id").alias("Job Name"), F.col("agent_name").alias("Agent Name"), F.col("metered_value").alias("Volume (GBs)"),
        F.date_format("s", "dd/MM/yyyy HH:mm").alias("Job Start Time (UTC)"),
        F.when(even, F.date_format("e", "dd/MM/yyyy HH:mm")).alias("Job End Time (UTC)"), F.date_format("e", "yyyy-MM-dd").alias("Metering Date (UTC)"),
        F.col("task_name").alias("Task Name"), F.col("environment").alias("Runtime Environment"),
    ), f"{folder}/bulk", compression="gzip")


def ingest_raw_files(spark, folder: str):
    paths = log_files.list_log_files(spark, folder, RAW_FILES)
    return log_files.ingest_files(spark, paths, RUN_DATE, orgs=lambda path: "North" if "tasks" in path else "South")[0]


def ingested(spark, d):
    folder = work_dir(spark, "raw-logs")
    write_raw_files(spark, d, folder)
    return ingest_raw_files(spark, folder)


INGESTED = f"""{base('tpch')}, x AS (SELECT *, log_type = 'Mass Ingestion' AND log_type IS NOT NULL AS bulk, CAST(task_id AS BIGINT) % 2 = 0 AS even FROM tasks),
y AS (SELECT CASE WHEN bulk THEN task_run_id ELSE task_id END AS task_id, task_name, CASE WHEN NOT bulk THEN task_object_name END AS task_object_name,
  CASE WHEN bulk THEN task_name ELSE task_type END AS task_type, task_run_id, agent_name, CASE WHEN NOT bulk THEN project_name END AS project_name,
  CASE WHEN NOT bulk THEN folder_name END AS folder_name, environment, CASE WHEN NOT bulk THEN cores_used END AS cores_used,
  start_time, CASE WHEN bulk AND NOT even THEN end_time + INTERVAL 86399 SECOND ELSE end_time END AS end_time,
  CASE WHEN NOT bulk THEN status WHEN even THEN 'Completed' ELSE 'Running' END AS status, metered_value,
  CASE WHEN bulk THEN 'South Mass Ingestion' ELSE 'North' END AS org, CASE WHEN bulk THEN 'Mass Ingestion' ELSE 'Task Usage' END AS log_type,
  DATE '2024-07-01' AS run_date FROM x),
z AS (SELECT *, round_even(metered_value * {FACTOR}, 8) AS ipus FROM y)"""
INGESTED_COLUMNS = (
    "task_id, task_name, task_object_name, task_type, task_run_id, agent_name, project_name, folder_name, environment, cores_used, "
    "start_time, end_time, status, metered_value, org, log_type, run_date, ipus"
)


@register("ingest_files", f"{INGESTED} SELECT {INGESTED_COLUMNS}, round_even(ipus * CAST(36.04 AS DOUBLE), 6) AS cost FROM z")
def ingest_files(spark, d):
    return ingested(spark, d).select(*INGESTED_COLUMNS.split(", "), "cost")


UNREAD_SQL = """SELECT 'Start Time: no date or number' AS error, COUNT(*) FILTER (l_linenumber = 1) AS cells FROM lineitem
UNION ALL SELECT 'Metered Value: no date or number', COUNT(*) FILTER (l_quantity > 40) FROM lineitem UNION ALL SELECT 'a row has more cells than the header', NULL"""


@register("ingest_errors", UNREAD_SQL)
def ingest_errors(spark, d):
    """Cells that are no dates or numbers, by file column, and a file with surplus cells."""
    folder = work_dir(spark, "odd-logs")
    t = table(spark, d, "lineitem")
    write_csv(t.select(
        F.col("l_partkey").alias("Task ID"), F.when(F.col("l_linenumber") == 1, "some day").otherwise(F.col("l_shipdate").cast("string")).alias("Start Time"),
        F.when(F.col("l_quantity") > 40, "much").otherwise(F.col("l_quantity").cast("string")).alias("Metered Value"),
    ), f"{folder}/cells")
    rows = t.limit(50).select(F.concat_ws(",", "l_partkey", "l_quantity", "l_tax").alias("value"))
    rows.unionByName(spark.createDataFrame([("Task ID,Metered Value",)], "value string")).coalesce(1).sortWithinPartitions(F.desc("value")).write.text(f"{folder}/surplus.csv")
    paths = log_files.list_log_files(spark, folder) + log_files.list_log_files(spark, folder, "*.txt")
    return log_files.ingest_files(spark, paths, RUN_DATE)[1].groupBy("error").agg(F.sum("cells").alias("cells"))


@register("ingest_inferred_orgs", f"""{base('tpch')} SELECT CASE WHEN TRIM(org) = '' THEN 'EAST' ELSE {BASE.format('org')} END AS org, COUNT(*) AS n FROM tasks GROUP BY 1""")
def ingest_inferred_orgs(spark, d):
    """Files named after their organization; the one without a name gets the first free label."""
    folder = work_dir(spark, "named-logs")
    t = tasks_tpch(spark, d).select(F.regexp_replace(F.trim("org"), " Mass Ingestion$", "").alias("org"), F.col("task_id").alias("Task ID"), F.col("metered_value").alias("Metered Value"))
    paths = []
    for org, name in (("", "first"), ("ASIA", "Asia"), ("AMERICA", "america-2024"), ("EUROPE", "usage_europe"), ("MIDDLE EAST", "Middle East (1)")):
        write_csv(t.where(F.col("org") == org).drop("org").repartition(1), f"{folder}/{name}")  # one task writes, all join
        paths.append(renamed(spark, log_files.list_log_files(spark, f"{folder}/{name}")[0], f"{folder}/{name}.csv"))
    rows, _ = log_files.ingest_files(spark, paths, RUN_DATE, log_types={p.rsplit("/", 1)[1]: TASK for p in paths}, catalog=tpch_organizations(spark))
    return rows.groupBy("org").agg(F.count("*").alias("n"))


@register("ingest_quoted", """SELECT concat(l_orderkey, '-', l_linenumber) AS task_run_id, concat('line "', l_returnflag, '",', chr(10), 'next, ', l_linestatus) AS task_name,
  CAST(l_partkey AS VARCHAR) AS task_id, l_quantity AS metered_value, 'Task Usage' AS log_type FROM lineitem""")
def ingest_quoted(spark, d):
    """Cells and a header with quotes, commas and line breaks."""
    folder = work_dir(spark, "quoted-logs")
    name = F.concat(F.lit('line "'), "l_returnflag", F.lit('",\nnext, '), "l_linestatus")
    write_csv(table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Task Run ID"), name.alias("Task Name"),
        F.lit("x").alias('free\n"text", any'), F.col("l_partkey").alias("Task ID"), F.col("l_quantity").alias("Metered Value"),
    ), folder)
    rows, _ = log_files.ingest_files(spark, log_files.list_log_files(spark, folder), RUN_DATE)
    return rows.select("task_run_id", "task_name", "task_id", "metered_value", "log_type")


IDENTITY_SQL = "concat_ws('|', " + ", ".join(
    f"concat(length(COALESCE({c}, '')), ':', COALESCE({c}, ''))" for c in (
        "task_id", "task_run_id", "task_name", "task_type", "project_name", "folder_name", "org", "environment", "agent_name", "log_type")
) + """, COALESCE(strftime(start_time, '%Y-%m-%d %H:%M:%S'), ''), COALESCE(strftime(end_time, '%Y-%m-%d %H:%M:%S'), ''),
CAST(CAST(ROUND(COALESCE(metered_value, 0), 6) AS DECIMAL(28,6)) AS VARCHAR))"""


@register("row_hash", f"{base('tpch')} SELECT task_run_id, sha256({IDENTITY_SQL}) AS row_hash FROM tasks")
def row_hash(spark, d):
    return dedup.with_row_hash(tasks_tpch(spark, d)).select("task_run_id", "row_hash")


@register("row_hash_dedup", f"""{base('tpch')}, x AS (SELECT DISTINCT sha256({IDENTITY_SQL}) AS row_hash, org, end_date, status FROM (
  SELECT * REPLACE ('run' AS task_run_id, CAST(NULL AS VARCHAR) AS task_id, '' AS task_name, 1.0 AS metered_value, '' AS agent_name, 'env' AS environment,
    CAST(NULL AS TIMESTAMP) AS start_time, 'f' AS folder_name) FROM tasks))
SELECT row_hash, MIN(status) AS status FROM x WHERE end_date < DATE '2000-01-01' AND row_hash NOT IN (SELECT row_hash FROM x WHERE status = 'P') GROUP BY 1""")
def row_hash_dedup(spark, d):
    """Coarsened rows collide on their hash: one stays per hash, and none that is stored already."""
    t = tasks_tpch(spark, d)
    coarse = t.withColumns({
        "task_run_id": F.lit("run"), "task_id": F.lit(None).cast("string"), "task_name": F.lit(""), "metered_value": F.lit(1.0),
        "agent_name": F.lit(""), "environment": F.lit("env"), "start_time": F.lit(None).cast("timestamp"), "folder_name": F.lit("f"),
    })
    hashed = dedup.with_row_hash(coarse).select("row_hash", "status", "end_date")
    staged = dedup.one_per_hash(hashed.where(F.col("end_date") < "2000-01-01").select("row_hash", "status"))
    return dedup.not_stored(staged, hashed.where(F.col("status") == "P"))


@register("duplicates_full_row", """WITH x AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
  CASE WHEN l_linenumber < 4 THEN l_linenumber END AS line FROM lineitem),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, line) AS n FROM x)
SELECT * EXCLUDE (n) FROM n WHERE n > 1""")
def duplicates_full_row(spark, d):
    line = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")).alias("line")
    t = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", line)
    return dedup.full_row_duplicates(t)


# --- history ---

HISTORY = ("task_run_id", "task_id", "org", "log_type", "start_time", "end_time", "metered_value", "ipus", "cost")


def stored_view(spark, d) -> str:
    """A history that was built by adding the same priced rows twice, in overlapping batches."""
    root = work_dir(spark, "history")
    rows = ingest.price(tasks_tpch(spark, d)).withColumn("source_file", F.lit("view"))
    early, late = F.col("end_date") < "1999-01-01", F.col("end_date") >= "1998-01-01"
    history.append_tasks(spark, root, rows.where(early), NOW)
    history.append_tasks(spark, root, rows.where(late), NOW)
    history.append_tasks(spark, root, rows.where(early & late), NOW)
    return root


STORED = f""", priced AS (SELECT *, round_even(round_even(metered_value * {FACTOR}, 8), 6) AS i,
  round_even(round_even(round_even(metered_value * {FACTOR}, 8) * CAST(36.04 AS DOUBLE), 6), 6) AS c FROM tasks)"""


@register("history_append", f"{base('tpch')}{STORED} SELECT task_run_id, task_id, NULLIF(org, '') AS org, log_type, start_time, end_time, "
                            "metered_value, i AS ipus, c AS cost FROM priced")
def history_append(spark, d):
    return history.read_history(spark, stored_view(spark, d)).select(*HISTORY)


@register("history_events", f"""{base('tpch')}, b AS (SELECT 1 AS nth, DATE '1900-01-01' AS a, DATE '1998-12-31' AS z UNION ALL SELECT 2, DATE '1999-01-01', DATE '2999-01-01')
SELECT 'ADD' AS action, MIN(CASE WHEN nth = 2 THEN s.f ELSE end_date END) AS start_date, MAX(end_date) AS end_date, COUNT(*) AS affected_rows,
  MAX(CASE WHEN nth = 1 THEN s.early ELSE s.n END) AS remaining_rows FROM b JOIN tasks ON end_date BETWEEN a AND z,
  (SELECT MIN(end_date) FILTER (end_date >= DATE '1998-01-01') AS f, COUNT(*) AS n, COUNT(*) FILTER (end_date < DATE '1999-01-01') AS early FROM tasks) s
GROUP BY nth""")
def history_events(spark, d):
    events = history.read_events(spark, stored_view(spark, d), "ADD")
    return events.select("action", "start_date", "end_date", "affected_rows", "remaining_rows")


@register("audit_display", f"""{base('tpch')}, early AS (SELECT MIN(end_date) AS a, MAX(end_date) AS z, COUNT(*) AS n FROM tasks WHERE end_date < DATE '1999-01-01'),
late AS (SELECT MIN(end_date) FILTER (end_date >= DATE '1998-01-01') AS a, MAX(end_date) AS z, COUNT(*) FILTER (end_date >= DATE '1999-01-01') AS n, COUNT(*) AS whole FROM tasks)
SELECT '2024-07-01 08:00:00' AS created_at, concat(a, ' to ', z) AS processed_date_range, n AS affected_rows, n AS remaining_rows FROM early
UNION ALL SELECT '2024-07-01 08:00:00', concat(a, ' to ', z), n, whole FROM late""")
def audit_display(spark, d):
    shown_rows = history.events_display(history.read_events(spark, stored_view(spark, d), "ADD"))
    return shown_rows.select("created_at", "processed_date_range", "affected_rows", "remaining_rows")


@register("export_round_trip", f"""{base('tpch')} SELECT task_run_id AS "Task Run ID", status AS "Status", metered_value AS "Metered Value",
  round_even(metered_value * {FACTOR}, 8) AS "IPUs" FROM tasks""")
def export_round_trip(spark, d):
    """A priced batch written under the standard titles and read back."""
    path = work_dir(spark, "export")
    export_batch(ingest.price(tasks_tpch(spark, d)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("Task Run ID", "Status", *[F.col(c).cast("double").alias(c) for c in ("Metered Value", "IPUs")])


@register("timestamp_export", f"""{base('events')} SELECT task_run_id, end_time, metered_value FROM tasks
WHERE end_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-11 18:30:00'""")
def timestamp_export(spark, d):
    path = work_dir(spark, "export")
    export_between(tasks_events(spark, d), dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 11, 18, 30), path, "parquet")
    return spark.read.parquet(path).select("task_run_id", "end_time", "metered_value")


@register("analysis_end", f"""{base('tpch')} SELECT task_run_id FROM tasks WHERE {days('1995-01-01', '1999-06-14')}""")
def analysis_end_rows(spark, d):
    """Rows up to the last whole day before the day of the analysis."""
    last = analysis_end("2001-12-31", "1999-06-15")
    return TaskFilter("1995-01-01", last).apply(tasks_tpch(spark, d)).select("task_run_id")


@register("history_delete", f"""{base('tpch')}{STORED} SELECT task_run_id, task_id, NULLIF(org, '') AS org, log_type, start_time, end_time, metered_value,
  i AS ipus, c AS cost FROM priced WHERE NOT COALESCE({days('1996-03-01', '1997-02-10')} AND environment = 'NATION_3', FALSE)
  AND NOT COALESCE({days('2000-01-01', '2000-03-31')}, FALSE)""")
def history_delete(spark, d):
    root = stored_view(spark, d)
    history.delete_tasks(spark, root, TaskFilter("1996-03-01", "1997-02-10", environment="NATION_3"), NOW)
    history.delete_tasks(spark, root, TaskFilter("2000-01-01", "2000-03-31"), NOW)
    return history.read_history(spark, root).select(*HISTORY)


@register("history_retag", f"""{base('tpch')}{STORED}, r AS (SELECT task_run_id, log_type, metered_value, c AS cost,
  CASE WHEN log_type = 'Mass Ingestion' AND org <> '' THEN concat(regexp_replace(org, ' Mass Ingestion$', ''), ' Mass Ingestion') ELSE NULLIF(org, '') END AS org,
  CASE WHEN log_type = 'Mass Ingestion' THEN round_even(metered_value * CAST(0.1 AS DOUBLE), 8) ELSE i END AS ipus FROM priced)
SELECT task_run_id, log_type, org, ipus FROM r UNION ALL SELECT 'event', 'RETAG', NULL, CAST(COUNT(*) AS DOUBLE) FROM r WHERE log_type = 'Mass Ingestion'""")
def history_retag(spark, d):
    """A history whose bulk rows came under plain names, some priced with the task factor, and some
    rows under both names; the event counts the bulk rows that were stored."""
    root = work_dir(spark, "history")
    rows = ingest.price(tasks_tpch(spark, d))
    bulk = F.coalesce(F.col("log_type") == BULK, F.lit(False))
    old = rows.withColumn("org", F.when(bulk, F.regexp_replace("org", " Mass Ingestion$", "")).otherwise(F.col("org")))
    old = old.withColumn("ipus", F.when(bulk, F.round(F.col("metered_value") * 0.16, 8)).otherwise(F.col("ipus")))
    history.append_tasks(spark, root, old, NOW)
    changed, _ = history.retag_tasks(spark, root, NOW)
    events = history.read_events(spark, root, "RETAG").select(
        F.lit("event").alias("task_run_id"), F.col("action").alias("log_type"), F.lit(None).cast("string").alias("org"), F.col("affected_rows").cast("double").alias("ipus")
    )
    return history.read_history(spark, root).select("task_run_id", "log_type", "org", "ipus").unionByName(events)


@register("delete_range_keep", f"""{base('tpch')} SELECT task_run_id FROM tasks
WHERE NOT COALESCE({days('1996-03-01', '1997-02-10')} AND status = 'F' AND log_type = 'Mass Ingestion', FALSE)""")
def delete_range_keep(spark, d):
    f = TaskFilter("1996-03-01", "1997-02-10", status="F", log_type="Mass Ingestion")
    return history.kept_rows(tasks_tpch(spark, d), f).select("task_run_id")


@register("history_org_stats", f"""{base('tpch')}{STORED} SELECT COALESCE(NULLIF(TRIM(org), ''), 'Unknown') AS org, COUNT(*) AS task_count,
{shown(total('i'))} AS total_ipus, {shown(total('c'))} AS total_cost FROM priced WHERE {days('1997-05-05', '1999-09-09')} GROUP BY 1""")
def history_org_stats(spark, d):
    """Totals read from the partitioned history."""
    from meterlake.functions.labels import org_label

    tasks = history.read_history(spark, stored_view(spark, d))
    return stats(TaskFilter("1997-05-05", "1999-09-09").apply(tasks), [org_label().alias("org")], Pricing())


@register("stream_ingest", f"""{INGESTED} SELECT org, log_type, end_time, COUNT(*) AS task_count, {shown(total('ipus'))} AS total_ipus FROM z GROUP BY 1, 2, 3""")
def stream_ingest(spark, d):
    """Files picked up by the stream and then delivered once more: every row is stored once."""
    from meterlake.streaming.ingest import start_ingest

    root = work_dir(spark, "stream")
    write_raw_files(spark, d, f"{root}/in/first")
    settings = {"orgs": lambda path: "North" if "tasks" in path else "South", "clock": lambda: NOW, "pattern": RAW_FILES}
    start_ingest(spark, f"{root}/in", root, f"{root}/_checkpoint", **settings).awaitTermination()
    write_raw_files(spark, d, f"{root}/in/again")
    start_ingest(spark, f"{root}/in", root, f"{root}/_checkpoint", **settings).awaitTermination()
    stored = history.read_history(spark, root)
    return stored.groupBy("org", "log_type", "end_time").agg(
        F.count(F.lit(1)).alias("task_count"), F.round(F.sum(F.col("ipus").cast("decimal(28,8)")), 6).cast("double").alias("total_ipus")
    )


@register("retag_bulk_rows", f"""{base('tpch')}, o AS (SELECT * REPLACE (regexp_replace(org, ' Mass Ingestion$', '') AS org) FROM tasks),
r AS (SELECT * REPLACE (CASE WHEN log_type = 'Mass Ingestion' AND TRIM(org) <> '' THEN concat(org, ' Mass Ingestion') ELSE org END AS org) FROM o)
SELECT task_run_id, org, CASE WHEN log_type = 'Mass Ingestion' AND TRIM(org) <> '' THEN sha256({IDENTITY_SQL}) ELSE 'old' END AS row_hash,
  CASE WHEN log_type = 'Mass Ingestion' THEN ROUND(metered_value * CAST(0.1 AS DOUBLE), 8) ELSE ipus END AS ipus,
  CASE WHEN log_type = 'Mass Ingestion' THEN ROUND(metered_value * CAST(0.1 AS DOUBLE) * CAST(36.04 AS DOUBLE), 6) ELSE cost END AS cost FROM r""")
def retag_bulk_rows(spark, d):
    old = tasks_tpch(spark, d).withColumns({
        "org": F.regexp_replace("org", " Mass Ingestion$", ""), "row_hash": F.lit("old"),
    })
    return ingest.retag_bulk_rows(old).select("task_run_id", "org", "row_hash", "ipus", "cost")


# --- organizations ---

@register("org_parents", f"""{base('tpch')} SELECT DISTINCT org, {TPCH_PARENT.format(BASE.format('org'))} AS parent FROM tasks""")
def org_parents(spark, d):
    orgs = tasks_tpch(spark, d).select("org").distinct()
    return O.parent_of(orgs, "org", tpch_organizations(spark))


@register("focus_parent", f"""{base('tpch')} SELECT task_run_id, org FROM tasks
WHERE org IN ('ASIA', 'ASIA Mass Ingestion', 'MIDDLE EAST', 'MIDDLE EAST Mass Ingestion')""")
def focus_parent(spark, d):
    return O.in_focus(tasks_tpch(spark, d), "EAST", tpch_organizations(spark)).select("task_run_id", "org")


@register("focus_single", f"{base('tpch')} SELECT task_run_id, org FROM tasks WHERE org = 'EUROPE Mass Ingestion'")
def focus_single(spark, d):
    return O.in_focus(tasks_tpch(spark, d), "EUROPE Mass Ingestion", tpch_organizations(spark)).select("task_run_id", "org")


@register("focus_options", f"""{base('tpch')} SELECT 'All orgs' AS option, 0 AS rank UNION ALL SELECT * FROM (VALUES ('EAST', 1), ('WEST', 1))
UNION ALL SELECT DISTINCT org, 2 FROM tasks WHERE TRIM(org) <> ''""")
def focus_options(spark, d):
    return O.focus_options(tpch_organizations(spark), tasks_tpch(spark, d))


@register("org_names", """SELECT c_custkey, CASE n_regionkey WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' WHEN 4 THEN 'MIDDLE EAST' ELSE '0' END AS org
FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT -1, 'Unknown' FROM region WHERE r_regionkey = 0""")
def org_names(spark, d):
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ids = customers.select("c_custkey", F.concat(F.lit(" "), F.col("n_regionkey").cast("string")).alias("org_id"))
    blank = table(spark, d, "region").where("r_regionkey = 0").select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(" ").alias("org_id"))
    return O.organization_names(ids.unionByName(blank), tpch_organizations(spark)).select("c_custkey", "org")


@register("org_discovery", f"""{base('tpch')}, n AS (SELECT DISTINCT {BASE.format('agent_name')} AS name FROM tasks)
SELECT name, CAST(50 + 10 * ROW_NUMBER() OVER (ORDER BY name) AS INTEGER) AS sort_order FROM n UNION ALL
SELECT * FROM (VALUES ('EAST', 0), ('WEST', 10), ('ASIA', 20), ('MIDDLE EAST', 30), ('AMERICA', 40), ('EUROPE', 50))""")
def org_discovery(spark, d):
    found = tasks_tpch(spark, d).select(F.concat("agent_name", F.lit(" Mass Ingestion")).alias("org"))
    return O.ensure_organizations(tpch_organizations(spark), found).select("name", "sort_order")


@register("org_insert", f"""SELECT concat('Org ', n_name) AS name, CAST(n_nationkey AS VARCHAR) AS external_id, r_name AS parent_name,
  lower(n_name) AS token, CAST(50 + 10 * ROW_NUMBER() OVER (ORDER BY concat('Org ', n_name)) AS INTEGER) AS sort_order
FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'EUROPE', '3', 'WEST', 'europe', 50""")
def org_insert(spark, d):
    """Organizations with their attributes; one that the catalog has stays as it is."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right")
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = rows.select(
        F.concat(F.lit("Org "), "n_name", F.when(F.col("c_custkey") % 2 == 0, " Mass Ingestion").otherwise("")).alias("org"),
        F.col("n_nationkey").cast("string").alias("external_id"), F.col("r_name").alias("parent_name"), F.array(F.concat(F.lit(" "), "n_name"), F.lit("")).alias("filename_tokens"),
    )
    known = table(spark, d, "region").select(F.col("r_name").alias("org"), F.lit("x").alias("external_id"), F.lit(None).cast("string").alias("parent_name"), F.array(F.lit("y")).alias("filename_tokens"))
    catalog = O.ensure_organizations(tpch_organizations(spark), found.unionByName(known.where("org = 'EUROPE'")))
    shown_names = F.col("name").startswith("Org ") | (F.col("name") == "EUROPE")
    return catalog.where(shown_names).select("name", "external_id", "parent_name", F.get("filename_tokens", F.lit(0)).alias("token"), "sort_order")


@register("org_mappings", """SELECT concat('c', c_custkey) AS external_id, c_name AS name FROM customer
UNION ALL SELECT * FROM (VALUES ('2', 'ASIA'), ('4', 'MIDDLE EAST'), ('1', 'AMERICA'), ('3', 'EUROPE'))""")
def org_mappings(spark, d):
    mappings = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("org_id"), F.col("c_name").alias("org_name"))
    return O.id_map(O.add_mappings(tpch_organizations(spark), mappings))


@register("org_options", """SELECT r_name AS org, r_regionkey AS sort_order, 0 AS twin FROM region UNION ALL
SELECT concat(r_name, ' Mass Ingestion'), r_regionkey, 1 FROM region""")
def org_options(spark, d):
    catalog = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("sort_order"))
    return O.organization_options(catalog)


@register("file_name_orgs", """SELECT concat(c_mktsegment, '_', r_name, '-', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' mass_ingestion' ELSE '' END, '.csv') AS file_name,
  concat(CASE WHEN r_name = 'AFRICA' THEN 'EAST' ELSE r_name END, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN ' Mass Ingestion' ELSE '' END) AS org
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def file_name_orgs(spark, d):
    rows = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    marker = F.when(F.col("c_custkey") % 2 == 0, " mass_ingestion").otherwise("")
    files = rows.select(
        F.concat("c_mktsegment", F.lit("_"), "r_name", F.lit("-"), F.col("c_custkey").cast("string"), marker, F.lit(".csv")).alias("file_name"),
        F.when(F.col("c_custkey") % 3 == 0, BULK).otherwise(TASK).alias("log_type"),
    )
    return O.file_name_orgs(files, tpch_organizations(spark)).select("file_name", "org")


@register("assign_orgs", f"""{base('tpch')} SELECT task_run_id, CASE WHEN log_type = 'Mass Ingestion' THEN concat(b, ' Mass Ingestion') WHEN swapped LIKE '% Mass Ingestion' THEN b
  ELSE swapped END AS org FROM (SELECT *, {BASE.format('org')} AS b, CASE WHEN log_type = 'Mass Ingestion' THEN regexp_replace(org, ' Mass Ingestion$', '')
  WHEN org = '' THEN '' ELSE concat(org, ' Mass Ingestion') END AS swapped FROM tasks)""")
def assign_orgs(spark, d):
    """Labels with the suffix on the wrong side are put right by log type."""
    suffixed = F.when(F.col("org") == "", "").otherwise(F.concat("org", F.lit(" Mass Ingestion")))
    wrong = F.when(F.col("log_type") == BULK, F.regexp_replace("org", " Mass Ingestion$", "")).otherwise(suffixed)
    rows = tasks_tpch(spark, d).withColumn("org", wrong).withColumn("log_type", F.coalesce("log_type", F.lit(TASK)))
    return ingest.assign_orgs(rows).select("task_run_id", "org")
