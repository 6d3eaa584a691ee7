"""Block-list scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_blocklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct trimmed entries without empty and comment lines.

    Emptiness and comments are tested before trimming, so a blank-only line stays as an empty
    entry, which matches no address.
    """
    line = F.col(column)
    return (
        lines.filter((line != "") & ~line.startswith("#"))
        .select(F.regexp_replace(line, r"\A\s+|\s+\z", "").alias("entry"))
        .distinct()
    )


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return clean_blocklist(spark.read.text(path))
