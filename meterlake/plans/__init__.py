"""Queries over the derived task views, each with the SQL that gives the same rows."""

import importlib

from meterlake.plans.registry import ORACLE, QUERIES

for _module in ("totals", "series", "months", "comparisons", "ingestion", "stored_cells", "texts"):
    importlib.import_module(f"meterlake.plans.{_module}")

__all__ = ["ORACLE", "QUERIES"]
