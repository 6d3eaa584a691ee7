"""Alert streams: duplicate suppression, enrichment, the recent buffer, counts and metrics."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.buffer import CAPACITY, append_events, recent_events
from emberwatch.operators.dashboard import SEVERITIES, severity_counts
from emberwatch.schemas import ALERT
from emberwatch.streaming.keys import KeyStore, day_of
from emberwatch.streaming.segments import CommitLog

# Poll interval.
POLL = "15 seconds"

METRICS = "run string, batch_id bigint, polled bigint, repeats bigint, written bigint"


def alert_key(columns: list[str] | None = None) -> Column:
    """The alert id if there is one, else a digest of the whole alert, or of its given columns."""
    names = [name for name in ALERT.names if columns is None or name in columns]
    content = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return F.coalesce(F.nullif(F.col("id"), F.lit("")), F.sha2(content, 256))


def _started(writer, once: bool, every: str) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint folder was given when it was new."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _firsts(batch: DataFrame, key: str) -> DataFrame:
    """One row of each key: the one whose content has the smallest digest, so a rerun keeps the same."""
    content = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    return batch.groupBy(F.col(key).alias("_own")).agg(
        F.min_by(F.struct("*"), content).alias("_row")).select("_row.*")


class Unseen:
    """The rows of a batch whose key no other batch has stored, each key once.

    Keys are stored by the day of the event, so a batch reads only the days it touches. Whether an
    alert is a repeat never depends on its age or on how the input is cut into batches. A batch
    that is run again gets the same rows. The batch is read once; what it is held in is released at
    the end.
    """

    def __init__(
        self, batch: DataFrame, key: str | None, event_time: str, path: str, run: str, batch_id: int
    ):
        self.polled = Observation()
        self.rows = batch.observe(self.polled, F.count("*").alias("n"))
        self.cached: list[DataFrame] = []
        if key:
            firsts = _firsts(self.rows, key).withColumn("_day", day_of(event_time)).persist()
            own = firsts.select(F.col(key).cast("string").alias("_key"), "_day")
            admitted = KeyStore(batch.sparkSession, f"{path}/_keys").admit(own, run, batch_id)
            self.cached = [firsts, admitted]
            known = admitted.select(F.col("_key").alias("_known"), F.col("_day").alias("_on"))
            found = (F.col(key).cast("string") == F.col("_known")) & (F.col("_day") == F.col("_on"))
            self.rows = firsts.join(known, found, "left_semi").drop("_day")

    def __enter__(self) -> Unseen:
        return self

    def __exit__(self, *failure) -> None:
        for held in self.cached:
            held.unpersist()


def start_results(
    alerts: DataFrame, enrich_batch: Callable[[DataFrame], DataFrame], path: str,
    checkpoint: str, once: bool = False, every: str = POLL, buffer_path: str | None = None,
    buffer_order: list[tuple[str, bool]] | None = None, capacity: int = CAPACITY,
    key: str | None = None, event_time: str = "ts",
) -> StreamingQuery:
    """Enrich each micro-batch and write it under its run and batch id.

    With ``key``, an alert whose key was stored before is dropped, whenever that was. A batch that is
    run again after a failure overwrites its own folder; a new checkpoint starts a new run
    and overwrites nothing. The buffer is fed from the written rows.
    """
    spark = alerts.sparkSession
    if buffer_path:
        create_buffer(enrich_batch(spark.createDataFrame([], alerts.schema)), buffer_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = _run_id(session, checkpoint)
        target = f"{path}/run={run}/batch_id={batch_id}"
        with Unseen(batch, key, event_time, path, run, batch_id) as unseen:
            fresh, stored = Observation(), Observation()
            found = enrich_batch(unseen.rows.observe(fresh, F.count("*").alias("n")))
            found = found.observe(stored, F.count("*").alias("n"))
            found.write.mode("overwrite").parquet(target)
        counts = [seen.get["n"] for seen in (unseen.polled, fresh, stored)]
        _write_metrics(session, path, run, batch_id, counts[0], counts[0] - counts[1], counts[2])
        if buffer_path:
            update_buffer(session.read.parquet(target), run, batch_id, buffer_path,
                          buffer_order or [], capacity)

    writer = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _started(writer, once, every)


def _write_metrics(
    spark: SparkSession, path: str, run: str, batch_id: int, *counts: int
) -> None:
    """One row beside the results; a batch that is run again replaces its own."""
    row = spark.createDataFrame([(run, batch_id, *counts)], METRICS).coalesce(1)
    row.write.mode("overwrite").json(f"{path}/_metrics/{run}-{batch_id}")


def batch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows read, repeats dropped and rows written by every batch of every run."""
    return spark.read.schema(METRICS).json(f"{path}/_metrics/*")


def _buffer_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path}/log")


def create_buffer(shape: DataFrame, path: str) -> None:
    """An empty first epoch, unless the buffer exists."""
    log = _buffer_log(shape.sparkSession, path)
    if log.latest()[0] < 0:
        rows = _buffer_rows(shape.limit(0).withColumn("epoch", F.lit(0).cast("bigint")), path)
        log.add(0, {"rows": rows, "runs": {}})


def _buffer_rows(rows: DataFrame, path: str) -> str:
    name = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    return name


def update_buffer(
    batch: DataFrame, run: str, batch_id: int, path: str, order: list[tuple[str, bool]],
    capacity: int = CAPACITY,
) -> None:
    """Commit the epoch after this batch: the last events of the epoch before it and the batch.

    Epochs rise over all runs, so a new checkpoint continues the buffer it finds. A batch that is
    in already adds nothing, and of two streams that commit at once the later one starts over.
    """
    spark = batch.sparkSession
    log = _buffer_log(spark, path)
    while True:
        epoch, state = log.latest()
        runs = state.get("runs", {})
        if runs.get(run, -1) >= batch_id:
            return
        # Only the end of the batch can stay, so it is cut before it meets the buffer.
        fresh = batch.withColumn("epoch", F.lit(epoch + 1).cast("bigint"))
        fresh = recent_events(fresh, order, 0, capacity)
        before = spark.read.parquet(f"{path}/{state['rows']}") if state else fresh.limit(0)
        kept = recent_events(append_events(before, fresh), [("epoch", True), *order], 0, capacity)
        rows = _buffer_rows(kept, path)
        if log.add(epoch + 1, {"rows": rows, "runs": {**runs, run: batch_id}}):
            return log.prune(lambda entry: {entry["rows"]})
        log.drop(rows)


def read_buffer(
    spark: SparkSession, path: str, order: list[tuple[str, bool]], limit: int = 100,
    capacity: int = CAPACITY,
) -> DataFrame:
    """The last ``limit`` events of the newest epoch; no rows if there is no buffer."""
    _, state = _buffer_log(spark, path).latest()
    if not state:
        return spark.createDataFrame([], "epoch bigint")
    rows = spark.read.parquet(f"{path}/{state['rows']}")
    return recent_events(rows, [("epoch", True), *order], limit, capacity)


def start_daily_counts(
    alerts: DataFrame, path: str, checkpoint: str, event_time: str = "ts", once: bool = False,
    every: str = POLL, key: str | None = None,
) -> StreamingQuery:
    """Severity counts per 24-hour window of each micro-batch; the windows' counts add up.

    No alert is too late to count. With ``key``, repeats are left out as in ``start_results``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        run = _run_id(batch.sparkSession, checkpoint)
        with Unseen(batch, key, event_time, path, run, batch_id) as unseen:
            counts = unseen.rows.groupBy(F.window(event_time, "24 hours").alias("day")).agg(
                *severity_counts()
            ).select("day.start", "day.end", "total", *SEVERITIES)
            counts.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    writer = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _started(writer, once, every)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every window over all batches."""
    names = ["total", *SEVERITIES]
    return spark.read.parquet(path).groupBy("start", "end").agg(
        *[F.sum(name).alias(name) for name in names]
    )


def progress(query: StreamingQuery) -> list[tuple[int, int, float]]:
    """Batch id, input rows and seconds of the recent micro-batches; none drops rows by age."""
    return [
        (p["batchId"], p["numInputRows"], p["batchDuration"] / 1000.0)
        for p in query.recentProgress
    ]


def repeat(
    start: Callable[[], StreamingQuery], delay: float, halt: threading.Event, rounds: int | None = None
) -> int:
    """A fixed delay: run a once-query to its end, then wait ``delay`` seconds, until ``halt`` is set.

    The interval of ``every`` counts from the start of a batch; here the wait counts from the end.
    Returns the finished runs, ``rounds`` at most.
    """
    done = 0
    while not halt.is_set() and (rounds is None or done < rounds):
        start().awaitTermination()
        done += 1
        halt.wait(delay)
    return done


def stop(query: StreamingQuery, timeout_seconds: int = 10) -> None:
    """Stop and wait for the current batch to end."""
    query.stop()
    query.awaitTermination(timeout_seconds)


def write_paced_files(
    rows: DataFrame, path: str, rows_per_file: int, order: str = "seq", file_format: str = "parquet"
) -> None:
    """Files of at most ``rows_per_file`` consecutive rows, for a stream of several files a trigger.

    Which file a file stream takes first depends on when it was written; where the order of
    batches matters, use ``start_paced``.
    """
    (
        rows.repartitionByRange(order).sortWithinPartitions(order)
        .write.option("maxRecordsPerFile", rows_per_file).mode("append")
        .format(file_format).save(path)
    )


def start_paced(
    rows: DataFrame, path: str, checkpoint: str, rows_per_batch: int, batches: int,
    order: str = "seq", every: str = "1 second",
) -> StreamingQuery:
    """Replay stored rows by row number: batch n holds numbers [n, n + 1) * ``rows_per_batch``.

    A counting source drives the batches and only its numbers decide which rows a batch
    holds, so the order is that of ``order``, a row number from 0. ``rows`` is read anew for each
    batch; the range reaches its scan. Nothing is written after ``batches``.
    """
    spark = rows.sparkSession
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def write(batch: DataFrame, batch_id: int) -> None:
        span = F.col(order).between(batch_id * rows_per_batch, (batch_id + 1) * rows_per_batch - 1)
        if batch_id < batches:
            rows.filter(span).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(processingTime=every).start()
    )
