"""The newest alerts out of a long history, from the files that can hold them.

An index keeps the time range and the row count of every file. The files that start latest and hold
enough rows together give a time that all wanted alerts have reached, so a file that ends before it is not
opened, however long the history is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.operators.topk import first_rows

INDEX = "file string, low timestamp, high timestamp, n bigint"


def refresh_index(spark: SparkSession, path: str, index: str, time: str = "ts") -> DataFrame:
    """Add the files the index does not have yet; only these are read, and of them only the time.

    Rows without a time stand at the very start.
    """
    found = spark.read.parquet(path)
    # Local files are spelled with one slash by the scan and with three by the listing.
    listed = [(re.sub("^file:/+", "file:/", f),) for f in found.inputFiles()]
    known = _read(spark, index)
    files = spark.createDataFrame(listed, "file string").join(known, "file", "left_anti")
    new = [r.file for r in files.collect()]
    if new:
        at = F.coalesce(F.col(time).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
        ranges = _files(spark, path, found, new).select(
            F.col("_metadata.file_path").alias("file"), at.alias("at")
        ).groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
        ranges.write.mode("append").parquet(index)
    return _read(spark, index)


def _files(spark: SparkSession, path: str, like: DataFrame, files: list[str]) -> DataFrame:
    """Some of a folder's files, with the columns that their folders name."""
    return spark.read.schema(like.schema).option("basePath", path).parquet(*files)


def _read(spark: SparkSession, index: str) -> DataFrame:
    spark.createDataFrame([], INDEX).write.mode("ignore").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def files_of_newest(index: DataFrame, limit: int) -> list[str]:
    """The files that can hold one of the ``limit`` newest rows.

    Every file in the index has a row, so the ``limit`` files that start latest are enough to reach it.
    """
    latest = first_rows(index, limit, F.desc("low"), F.asc("file"))
    upto = F.sum("n").over(Window.orderBy(F.desc("low"), F.asc("file")))
    reached = latest.withColumn("upto", upto).filter(F.col("upto") >= limit).agg(F.max("low")).first()[0]
    able = index if reached is None else index.filter(F.col("high") >= F.lit(reached))
    return [r.file for r in able.select("file").collect()]


def newest_from_files(
    spark: SparkSession, path: str, index: str, limit: int = 10, time: str = "ts", tiebreak: str = "id"
) -> DataFrame:
    """The ``limit`` newest alerts below ``path``, newest first, by ``time`` and then ``tiebreak``."""
    all_rows = spark.read.parquet(path)
    files = files_of_newest(refresh_index(spark, path, index, time), limit)
    rows = _files(spark, path, all_rows, files) if files else all_rows.limit(0)
    return first_rows(rows, limit, F.col(time).desc_nulls_last(), F.col(tiebreak).desc_nulls_last())
