"""Row identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that identify a run, in hash order. Status, units and cost may
# change between deliveries of the same run and stay out.
IDENTITY_TEXT = [
    "task_id", "task_run_id", "task_name", "task_type", "project_name", "folder_name",
    "org", "environment", "agent_name", "log_type",
]
IDENTITY_TIMES = ["start_time", "end_time"]


def _with_length(text: Column) -> Column:
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def row_hash() -> Column:
    """SHA-256 over the 13 identity columns. Every text comes after its length, so that no text can
    pass for two parts; NULL counts as '', which is how the history stores a blank. Amounts are
    fixed-point so that 12 and 12.0 agree."""
    texts = [_with_length(F.coalesce(F.col(c), F.lit(""))) for c in IDENTITY_TEXT]
    times = [F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")) for c in IDENTITY_TIMES]
    amount = F.round(F.coalesce(F.col("metered_value"), F.lit(0.0)), 6).try_cast("decimal(28,6)")
    metered = F.coalesce(amount.cast("string"), F.col("metered_value").cast("string"))
    return F.sha2(F.concat_ws("|", *texts, *times, metered), 256)
