"""Raw rows and alerts to the common event shape."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.extract import (
    addresses, clock, nth_address, parse_timestamp, parse_user,
)
from emberwatch.functions.text import blank_to_null, first_filled, safe_int

UNKNOWN = "unknown"
UNKNOWN_ADDRESS = "0.0.0.0"
AsOf = str | datetime | None


def field_value(df: DataFrame, name: str) -> Column:
    """A column by name, or null if the frame has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The source row kept as a map from column name to text."""
    names = columns or df.columns
    return F.create_map(*[
        part for name in names for part in (F.lit(name), F.col(f"`{name}`").cast("string"))
    ])


def row_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def row_json(df: DataFrame) -> Column:
    return F.to_json(row_struct(df))


def normalize_fields(
    rows: DataFrame, source: str = "csv_dataset", as_of: AsOf = None,
    row_columns: list[str] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that already have field columns, any of which may be absent."""

    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in rows.columns else default

    return rows.select(
        *keep,
        given("timestamp", clock(as_of).text).alias("timestamp"),
        first_filled(field_value(rows, "src_ip"), field_value(rows, "source_ip"))
        .alias("source_ip"),
        first_filled(field_value(rows, "dst_ip"), field_value(rows, "destination_ip"))
        .alias("destination_ip"),
        given("event_type", F.lit(UNKNOWN)).alias("event_type"),
        field_value(rows, "user").alias("user"),
        F.lit(0).alias("severity"),
        given("message", F.lit("")).alias("message"),
        F.lit(source).alias("source"),
        whole_row(rows, row_columns).alias("context"),
    )


def normalize_logs(
    rows: DataFrame, source: str = "csv_dataset", as_of: AsOf = None,
    row_columns: list[str] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of a raw ``log`` line and its ``category``."""
    has_category = "category" in rows.columns
    log = F.coalesce(field_value(rows, "log"), F.lit(""))
    staged = rows.select(
        *keep,
        log.alias("message"),
        (F.col("category") if has_category else F.lit(UNKNOWN)).alias("event_type"),
        addresses(log).alias("found"),
        whole_row(rows, row_columns).alias("raw"),
    )
    message = F.col("message")
    return staged.select(
        *keep,
        parse_timestamp(message, clock(as_of)).alias("timestamp"),
        "event_type",
        nth_address(F.col("found"), 0).alias("source_ip"),
        nth_address(F.col("found"), 1).alias("destination_ip"),
        parse_user(message).alias("user"),
        F.lit(0).alias("severity"),
        "message",
        F.lit(source).alias("source"),
        "raw",
    )


def normalize_alerts(alerts: DataFrame, as_of: AsOf = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested alerts to events; ``keep`` names extra input columns to carry along.

    ``target_port`` and ``origin_port`` stay as text for ``fill_defaults``.
    """
    staged = alerts.select(
        *keep, "timestamp", "rule", "data", "agent",
        F.coalesce(F.col("full_log"), F.lit("")).alias("full_log"),
        addresses(F.col("full_log")).alias("found"),
    )
    log = F.col("full_log")
    port = safe_int(F.col("data.dstport"))
    return staged.select(
        *keep,
        first_filled(
            F.col("data.srcip"),
            F.when(log != "", nth_address(F.col("found"), 0)).otherwise(F.col("data.srcip")),
        ).alias("source_ip"),
        first_filled(nth_address(F.col("found"), 1), F.col("agent.ip")).alias("destination_ip"),
        F.nullif(port, F.lit(0)).alias("port"),
        parse_user(log).alias("user"),
        F.coalesce(F.get(F.col("rule.groups"), F.lit(0)), F.lit(UNKNOWN)).alias("event_type"),
        first_filled(F.col("timestamp"), clock(as_of).text).alias("timestamp"),
        first_filled(log, F.coalesce(F.col("rule.description"), F.lit(""))).alias("raw_log"),
        safe_int(F.col("rule.level")).alias("level"),
        F.col("rule.id").alias("rule_id"),
        F.lit("normalized").alias("status"),
        F.col("data.dstport").alias("target_port"),
        F.col("data.srcport").alias("origin_port"),
    )


def fill_defaults(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events ready for scoring: no missing address, port or level, and the state starts over."""

    def address(name: str) -> Column:
        return F.coalesce(blank_to_null(F.col(name)), F.lit(UNKNOWN_ADDRESS)).alias(name)

    port = safe_int(first_filled(F.col("target_port"), F.col("origin_port")))
    return events.select(
        *keep,
        address("source_ip"),
        address("destination_ip"),
        F.coalesce(port, F.lit(0)).alias("port"),
        "user", "event_type", "timestamp", "raw_log",
        F.coalesce(F.col("level"), F.lit(0)).alias("level"),
        "rule_id",
        F.lit("pending").alias("status"),
    )
