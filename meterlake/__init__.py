"""Metered-usage analytics as Spark DataFrame operators."""

from meterlake.schema import BULK, TASK, Pricing

__all__ = ["BULK", "TASK", "Pricing"]
