"""Alert scans: JSON lines, search envelopes, newest-N and the file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.extract import parse_instant
from emberwatch.functions.text import first_filled
from emberwatch.operators.topk import first_rows
from emberwatch.schemas import ALERT, ALERT_ENVELOPE


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts as JSON lines; ``path`` may be a glob over dated folders.

    A line that is no JSON fails the read; it never becomes an alert or goes missing.
    """
    return spark.read.schema(ALERT).option("mode", "FAILFAST").json(path)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Alerts out of search answers, one JSON document per line."""
    return unnest_envelope(
        spark.read.schema(ALERT_ENVELOPE).option("mode", "FAILFAST").json(path)
    )


def parse_envelopes(documents: DataFrame, column: str = "value") -> DataFrame:
    """Alerts out of a text column of search answers; an unreadable answer fails the job."""
    answer = F.from_json(column, ALERT_ENVELOPE, {"mode": "FAILFAST"}).alias("answer")
    return unnest_envelope(documents.select(answer).select("answer.*"))


def unnest_envelope(answers: DataFrame) -> DataFrame:
    """One row per hit; an answer without hits gives none.

    The hit's own id stands in where the alert itself has none.
    """
    hits = answers.select(F.explode("hits.hits").alias("hit")).select("hit._id", "hit._source.*")
    return hits.withColumn("id", first_filled(F.col("id"), F.col("_id"))).drop("_id")


def alert_instant() -> Column:
    return parse_instant(first_filled(F.col("`@timestamp`"), F.col("timestamp")))


def newest_alerts(
    alerts: DataFrame, limit: int = 10, by: Column | None = None, tiebreak: str = "id"
) -> DataFrame:
    """The newest ``limit`` alerts, newest first: a per-task top-k, then one merge of the tops."""
    at = alert_instant() if by is None else by
    return first_rows(alerts, limit, at.desc_nulls_last(), F.col(tiebreak).desc_nulls_last())


def stream_alerts(
    spark: SparkSession, path: str, files_per_batch: int | None = None,
    schema: T.StructType = ALERT, file_format: str = "json",
) -> DataFrame:
    """New files below ``path`` as a stream; the file log is the cursor, so nothing is read twice."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
