"""Dashboard counts and table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dashboard severities and table columns.
SEVERITIES = ["critical", "high", "medium", "low"]
TABLE_COLUMNS = [
    "id", "timestamp", "event_type", "source_ip", "user", "severity", "score", "status",
]


def severity_counts() -> list[Column]:
    """Total and per-severity counts as aggregates of one pass."""
    return [F.count("*").alias("total")] + [
        F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES
    ]


def severity_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*severity_counts())


def kpis_since(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The counts over the hours before ``as_of``; the time filter reaches the scan."""
    start = as_of - F.expr(f"interval {hours} hours")
    return severity_kpis(alerts.filter((F.col("ts") > start) & (F.col("ts") <= as_of)))


def dashboard_table(alerts: DataFrame) -> DataFrame:
    return alerts.select(*TABLE_COLUMNS)
