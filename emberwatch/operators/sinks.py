"""Batch sinks and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberwatch.session import scratch_path


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines; the row count comes from the write itself, not from a second pass.

    A second run replaces the first unless ``mode`` is append.
    """
    counted = Observation()
    rows.observe(counted, F.count("*").alias("rows")).write.mode(mode).json(path)
    return counted.get["rows"]


def write_results(
    results: DataFrame, path: str, day: str | None = None, mode: str = "overwrite"
) -> int:
    """Parquet, by day if a date column is named, so that time filters prune folders."""
    counted = Observation()
    writer = results.observe(counted, F.count("*").alias("rows")).write.mode(mode)
    (writer.partitionBy(day) if day else writer).parquet(path)
    return counted.get["rows"]


def write_json_array(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """One JSON array over the part files: joined in the order of their names they are one document.

    The rows are turned to text once and stored with their number, so that the one that opens the array
    without a comma is known; all parts are then written in parallel. Returns the row count.
    """
    spark, counted = rows.sparkSession, Observation()
    store = scratch_path(spark, "json-array")
    elements = rows.select(
        F.monotonically_increasing_id().alias("place"), F.to_json(F.struct("*")).alias("element"))
    elements.observe(counted, F.count("*").alias("rows")).write.parquet(store)
    elements = spark.read.schema("place bigint, element string").parquet(store)
    first = elements.agg(F.min("place")).first()[0]
    comma = F.when(F.col("place") == F.lit(first), F.lit("")).otherwise(F.lit(","))
    body = elements.repartitionByRange("place").sortWithinPartitions("place").select(
        F.concat(comma, F.col("element")).alias("value"))
    frame = [spark.range(0, 1, 1, 1).select(F.lit(mark).alias("value")) for mark in "[]"]
    frame[0].union(body).union(frame[1]).write.mode(mode).text(path)
    return counted.get["rows"]
