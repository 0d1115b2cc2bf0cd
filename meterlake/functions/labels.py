"""Display labels and organization names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.schema import BULK_SUFFIX, TASK


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def label(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def org_label(c: Column | None = None) -> Column:
    return label(F.col("org") if c is None else c, "Unknown")


def log_type_label(c: Column | None = None) -> Column:
    return label(F.col("log_type") if c is None else c, TASK)


def is_bulk_org(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).endswith(BULK_SUFFIX)


def base_org(c: Column) -> Column:
    """Organization without the bulk suffix; blank is Unknown."""
    return label(F.regexp_replace(F.trim(c), BULK_SUFFIX + "$", ""), "Unknown")


def bulk_org(c: Column) -> Column:
    """Organization with the bulk suffix."""
    name = label(c, "Unknown")
    return F.when(name.endswith(BULK_SUFFIX), name).otherwise(F.concat(name, F.lit(BULK_SUFFIX)))


def env_base(c: Column) -> Column:
    """Environment text before the first " - "."""
    return label(F.substring_index(F.trim(c), " - ", 1), "Unknown")


def display_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMMM d, yyyy"), F.lit(""))


def display_range(start: Column, end: Column) -> Column:
    one_day = end.isNull() | (start == end)
    return F.when(one_day, display_date(start)).otherwise(F.concat(display_date(start), F.lit(" to "), display_date(end)))


def iso_range(start: Column, end: Column) -> Column:
    first, last = start.cast("string"), end.cast("string")
    return F.when(start == end, first).otherwise(F.concat(first, F.lit(" to "), last))


def grouped(c: Column, places: int = 2) -> Column:
    """1234.5 as 1,234.50."""
    return F.format_string(f"%,.{places}f", c.cast("double"))


def signed(c: Column, places: int = 2) -> Column:
    return F.format_string(f"%+,.{places}f", c.cast("double"))


def arrow(c: Column, places: int = 2) -> Column:
    """A change with its direction, as used in the reports."""
    return F.concat(F.when(c >= 0, F.lit("↑ ")).otherwise(F.lit("↓ ")), grouped(F.abs(c), places))


def percent_change(cur: Column, prev: Column) -> Column:
    pct = (cur - prev) / F.nullif(prev, F.lit(0.0)) * 100
    return (
        F.when((prev == 0) & (cur == 0), F.lit("n/a"))
        .when(prev == 0, F.lit("new"))
        .otherwise(F.format_string("%+.1f%%", pct))
    )


def trend(cur: Column, prev: Column) -> Column:
    pct = (cur - prev) / F.nullif(prev, F.lit(0.0)) * 100
    return (
        F.when((prev == 0) & (cur > 0), F.lit("new activity"))
        .when(prev == 0, F.lit("flat"))
        .when(F.abs(pct) < 5, F.lit("roughly flat"))
        .when(pct > 0, F.format_string("up (%+.0f%%)", pct))
        .otherwise(F.format_string("down (%+.0f%%)", pct))
    )
