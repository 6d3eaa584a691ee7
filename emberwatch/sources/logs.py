"""CSV log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMNS = ["source_file", "source_block", "source_row"]


def read_log_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV with doubled quotes, every column text.

    Columns come from the files' header, whatever their number and order. Files are split over
    tasks unless ``multi_line`` asks for quoted newlines to be kept together, which makes a file
    one task. The reader does not tell an empty cell from a missing one; both are empty text.
    """
    rows = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return rows.na.fill("")


def with_file_order(rows: DataFrame) -> DataFrame:
    """Columns that restore the reading order of a file scan.

    Row ids grow within a split, and splits are ordered by their start, so the three columns
    order a whole file without a shuffle.
    """
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )
