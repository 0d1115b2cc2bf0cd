"""Registry of check queries and the SQL pieces their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TPCH_SQL = """
SELECT CAST(l.l_partkey AS VARCHAR) AS task_id, p.p_name AS task_name,
  CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE concat('obj_', p.p_name) END AS task_object_name,
  p.p_type AS task_type, concat(l.l_orderkey, '-', l.l_linenumber) AS task_run_id,
  s.s_name AS agent_name,
  CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL WHEN l.l_returnflag = 'R' THEN '-' ELSE c.c_mktsegment END AS project_name,
  o.o_orderpriority AS folder_name,
  CASE WHEN r.r_name = 'AFRICA' THEN '' WHEN l.l_returnflag = 'R' THEN concat(r.r_name, ' Mass Ingestion') ELSE r.r_name END AS org,
  CASE WHEN l.l_linenumber % 2 = 0 THEN concat(n.n_name, ' - Cloud') ELSE n.n_name END AS environment,
  o.o_orderstatus AS status,
  CASE l.l_returnflag WHEN 'R' THEN 'Mass Ingestion' WHEN 'A' THEN NULL ELSE 'Task Usage' END AS log_type,
  o.o_orderdate AS start_time, l.l_shipdate AS end_time, CAST(l.l_shipdate AS DATE) AS end_date,
  CASE WHEN l.l_linestatus = 'F' THEN NULL ELSE l.l_quantity * CAST(0.16 AS DOUBLE) END AS ipus,
  CAST(NULL AS DOUBLE) AS cost, l.l_quantity AS metered_value, CAST(p.p_size AS DOUBLE) AS cores_used
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

EVENTS_SQL = """
SELECT CAST(user_id AS VARCHAR) AS task_id, concat(event_type, '_', user_id % 10) AS task_name,
  CAST(NULL AS VARCHAR) AS task_object_name, event_type AS task_type, CAST(event_id AS VARCHAR) AS task_run_id,
  concat('agent_', user_id % 7) AS agent_name, concat('project_', user_id % 12) AS project_name,
  concat('folder_', user_id % 3) AS folder_name,
  CASE WHEN event_type = 'error' THEN concat('org_', user_id % 5, ' Mass Ingestion') ELSE concat('org_', user_id % 5) END AS org,
  concat('env_', user_id % 4, CASE WHEN event_id % 2 = 0 THEN ' - Cloud' ELSE '' END) AS environment,
  CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'Mass Ingestion' ELSE 'Task Usage' END AS log_type,
  ts AS start_time, ts AS end_time, CAST(ts AS DATE) AS end_date,
  CAST(NULL AS DOUBLE) AS ipus, CAST(NULL AS DOUBLE) AS cost, value AS metered_value, CAST(user_id % 8 AS DOUBLE) AS cores_used
FROM events
"""

FACTOR = "CASE WHEN TRIM(log_type) = 'Mass Ingestion' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.16 AS DOUBLE) END"
EI = f"COALESCE(ipus, COALESCE(metered_value, 0) * {FACTOR})"
EC = f"COALESCE(cost, {EI} * CAST(36.04 AS DOUBLE))"
ORG = "COALESCE(NULLIF(TRIM(org), ''), 'Unknown')"
LOG = "COALESCE(NULLIF(TRIM(log_type), ''), 'Task Usage')"
PROJECT = "COALESCE(NULLIF(TRIM(project_name), ''), '-')"
TASK_NAME = "COALESCE(NULLIF(TRIM(task_name), ''), '(Unnamed)')"
ENV = "COALESCE(NULLIF(TRIM(split_part(TRIM(environment), ' - ', 1)), ''), 'Unknown')"
BASE = "COALESCE(NULLIF(TRIM(regexp_replace(TRIM({0}), ' Mass Ingestion$', '')), ''), 'Unknown')"
TPCH_PARENT = (
    "CASE WHEN {0} IN ('EAST', 'WEST') THEN {0} WHEN {0} IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' "
    "WHEN {0} IN ('AMERICA', 'EUROPE') THEN 'WEST' ELSE 'Other' END"
)
EVENTS_PARENT = (
    "CASE WHEN {0} IN ('org_0', 'org_1', 'org_2') THEN 'org_0' WHEN {0} IN ('org_3', 'org_4') THEN 'org_3' ELSE 'Other' END"
)


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,8))"


def total(x: str) -> str:
    return f"COALESCE(SUM({dec(x)}), 0)"


def shown(x: str, places: int = 6) -> str:
    return f"CAST(ROUND({x}, {places}) AS DOUBLE)"


def half_even(x: str, places: int = 2) -> str:
    return f"round_even(CAST({x} AS DOUBLE), {places})"


STATS = f"COUNT(*) AS task_count, {shown(total(EI))} AS total_ipus, {shown(total(EC))} AS total_cost"
UNIQUE = "COUNT(DISTINCT task_id) AS unique_tasks"


def base(view: str) -> str:
    return f"WITH tasks AS ({TPCH_SQL if view == 'tpch' else EVENTS_SQL})"


def days(start: str, end: str, column: str = "end_date") -> str:
    return f"{column} BETWEEN DATE '{start}' AND DATE '{end}'"


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep
