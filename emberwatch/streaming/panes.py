"""Severity counts of the last hours at any reading time, on a stream.

Each batch adds counts per pane of a minute and severity; panes add up, over batches and runs, so a late
alert counts from when it arrives in every window its time lies in, and nothing waits for a
watermark. A window is a sum of whole panes, read by the days it touches. A pane holds its end
and not its start, like a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.dashboard import SEVERITIES, severity_counts
from emberwatch.streaming.alerts import POLL, Unseen, _run_id, _started
from emberwatch.streaming.keys import day_of
from emberwatch.streaming.segments import FAN, Segments

PANE_SECONDS = 60
NAMES = ["total", *SEVERITIES]
SHAPE = "pane bigint, " + ", ".join(f"{n} bigint" for n in NAMES) + ", _day string"


def added_up(panes: DataFrame) -> DataFrame:
    sums = [F.sum(n).alias(n) for n in NAMES]
    return panes.groupBy("pane", "_day").agg(*sums).select("pane", *NAMES, "_day")


def panes_of(rows: DataFrame, event_time: str = "ts") -> DataFrame:
    """Counts per pane; ``pane`` is its end in seconds since 1970. Rows without a time have none."""
    end = F.ceil(F.unix_micros(event_time) / F.lit(PANE_SECONDS * 1_000_000)) * PANE_SECONDS
    counts = rows.groupBy(end.cast("bigint").alias("pane")).agg(*severity_counts())
    day = F.timestamp_seconds("pane")
    return counts.withColumn("_end", day).withColumn("_day", day_of("_end")).drop("_end")


def store(spark: SparkSession, path: str, fan: int = FAN) -> Segments:
    return Segments(spark, path, SHAPE, fan, fold=added_up)


def start_rolling_counts(
    alerts: DataFrame, path: str, checkpoint: str, event_time: str = "ts", once: bool = False,
    every: str = POLL, key: str | None = None,
) -> StreamingQuery:
    """Add every micro-batch's panes; with ``key``, repeats are left out as in ``start_results``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        run = _run_id(batch.sparkSession, checkpoint)
        with Unseen(batch, key, event_time, path, run, batch_id) as unseen:
            added = panes_of(unseen.rows, event_time)
            store(batch.sparkSession, f"{path}/panes").add(added, run, batch_id)

    writer = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _started(writer, once, every)


def rolling_counts(
    spark: SparkSession, path: str, instants: Sequence[datetime], hours: int = 24
) -> DataFrame:
    """One row of counts for the ``hours`` up to each reading time, in UTC, cut to whole panes."""
    ends = sorted({int(i.replace(tzinfo=i.tzinfo or timezone.utc).timestamp()) for i in instants})
    whole = [e - e % PANE_SECONDS for e in ends]
    days = set()
    for end in whole:
        at = datetime.fromtimestamp(end, timezone.utc)
        days |= {(at - timedelta(hours=h)).strftime("%Y-%m-%d") for h in range(hours + 1)}
    asked = spark.createDataFrame(list(zip(ends, whole)), "asked bigint, last bigint")
    # Few reading times, so each pane is dealt to those whose window it lies in, without a join.
    within = F.filter(F.array(*[F.lit(w) for w in whole]), lambda w: (
        (F.col("pane") <= w) & (F.col("pane") > w - hours * 3600)))
    panes = store(spark, f"{path}/panes").read(sorted(days))
    counts = panes.select(F.explode(F.array_distinct(within)).alias("last"), *NAMES).groupBy("last").agg(
        *[F.sum(n).alias(n) for n in NAMES])
    return asked.join(counts, "last", "left").select(
        F.timestamp_seconds("asked").alias("as_of"),
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in NAMES],
    )
