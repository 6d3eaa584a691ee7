import threading
import time
from datetime import datetime

from pyspark.sql import functions as F

from emberwatch.operators import results
from emberwatch.plans import catalog, tables
from emberwatch.schemas import ALERT
from emberwatch.sources.alerts import stream_alerts
from emberwatch.streaming import alerts as streams
from emberwatch.streaming import panes
from emberwatch.streaming.keys import KeyStore
from emberwatch.streaming.segments import KEPT_EPOCHS, CommitLog, merges

ORDER = [("ts", False), ("alert_id", False)]
KEEP = ("alert_id", "ts")


def enriched(batch):
    return results.enrich(batch, as_of=catalog.AS_OF, keep=KEEP)


def test_batches_equal_one_run_and_repeats_are_dropped(spark, sf, folder):
    """Every file is delivered twice and in several micro-batches; each alert comes out once."""
    source, out, buffer = folder("source"), folder("out"), folder("buffer")
    batch = tables.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.write_paced_files(batch, source, 400, "alert_id")
    batch.coalesce(1).write.mode("append").parquet(source)
    stream = stream_alerts(spark, source, 2, batch.schema, "parquet")
    run = streams.start_results(stream, enriched, out, folder("state"), once=True,
                                buffer_path=buffer, buffer_order=ORDER, key="alert_id")
    run.awaitTermination()
    seen = streams.progress(run)
    assert len(seen) > 1 and sum(rows for _, rows, _ in seen) == 2 * batch.count()
    got, want = spark.read.parquet(out).drop("batch_id", "run"), enriched(batch)
    assert got.count() == want.count() == 1000
    names = ["alert_id", "severity", "label", "explanation"]
    assert got.select(names).exceptAll(want.select(names)).count() == 0
    kept = streams.read_buffer(spark, buffer, ORDER, 0)
    full = spark.read.parquet(out)
    assert kept.count() == 500
    tail = full.orderBy(F.desc("batch_id"), "ts", "alert_id").limit(500)
    assert kept.columns == [*enriched(batch).columns, "epoch"]
    assert kept.select("alert_id").exceptAll(tail.select("alert_id")).count() == 0
    page = [r.alert_id for r in streams.read_buffer(spark, buffer, ORDER, 10).collect()]
    assert page == [r.alert_id for r in kept.collect()][-10:]
    assert len(CommitLog(spark, f"{buffer}/log").epochs()) == KEPT_EPOCHS
    assert streams.read_buffer(spark, folder("nothing"), ORDER).count() == 0


def test_restart_reads_only_new_files(spark, sf, folder):
    source, out, state = folder("source"), folder("out"), folder("state")
    batch = tables.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("alert_id < 300", "alert_id >= 300"):
        batch.filter(part).write.mode("append").parquet(source)
        stream = stream_alerts(spark, source, None, batch.schema, "parquet")
        run = streams.start_results(stream, enriched, out, state, once=True)
        run.awaitTermination()
    sizes = {r.batch_id: r["count"] for r in
             spark.read.parquet(out).groupBy("batch_id").count().collect()}
    assert sorted(sizes.values()) == [300, 700]


def test_a_new_checkpoint_overwrites_nothing(spark, sf, folder):
    source, out = folder("source"), folder("out")
    batch = tables.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("alert_id < 300", "alert_id >= 300"):
        batch.filter(part).write.mode("append").parquet(source)
        stream = stream_alerts(spark, source, None, batch.schema, "parquet")
        run = streams.start_results(stream, enriched, out, folder("state"), once=True, key="alert_id")
        run.awaitTermination()
    assert spark.read.parquet(out).count() == 1000


def test_a_batch_run_again_changes_nothing(spark, sf, folder):
    out = folder("out")
    batch = tables.alerts(spark, sf).limit(50)
    for batch_id in (0, 0, 1):
        with streams.Unseen(batch, "alert_id", "ts", out, "r", batch_id) as unseen:
            assert unseen.rows.count() == (50 if batch_id == 0 else 0)
            assert unseen.polled.get["n"] == 50


def test_the_buffer_goes_on_over_restarts(spark, folder):
    """Five batches of one stream, then one each of two streams with new checkpoints."""
    buffer, order = folder("buffer"), [("n", True)]

    def batch(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "n long")

    def held(limit=0):
        return [r.n for r in streams.read_buffer(spark, buffer, order, limit, 4).collect()]

    streams.create_buffer(batch(), buffer)
    assert held() == []
    for i in range(5):
        streams.update_buffer(batch(i), "first", i, buffer, order, 4)
    assert held() == [1, 2, 3, 4]
    streams.update_buffer(batch(100), "second", 0, buffer, order, 4)
    assert held() == [2, 3, 4, 100]
    streams.update_buffer(batch(200, 201), "third", 0, buffer, order, 4)
    for run, number in (("first", 4), ("second", 0), ("third", 0)):
        streams.update_buffer(batch(999), run, number, buffer, order, 4)
    assert held() == [4, 100, 200, 201] and held(3) == [100, 200, 201]
    streams.create_buffer(batch(), buffer)
    assert held() == [4, 100, 200, 201]


def test_of_two_writers_one_gets_the_epoch(spark, folder):
    path = folder("log")
    one, two = CommitLog(spark, path), CommitLog(spark, path)
    assert one.latest() == (-1, {})
    assert one.add(0, {"by": "one"}) and not two.add(0, {"by": "two"})
    assert two.add(1, {"by": "two", "text": "é"}) and one.latest() == (1, {"by": "two", "text": "é"})


def test_segments_stay_few_over_a_thousand_batches():
    levels = []
    for _ in range(1000):
        levels.append(0)
        while chosen := merges(levels, 8):
            up = levels[chosen[0]] + 1
            levels = [x for i, x in enumerate(levels) if i not in chosen] + [up]
        assert len(levels) <= 28
    assert sum(8**x for x in levels) == 1000


def test_keys_are_found_whatever_was_merged(spark, folder):
    """Ten batches, each with old and new keys of two days; files a day stay few."""
    path, days = folder("keys"), ("2031-01-01", "2031-01-02")
    store, seen = KeyStore(spark, path, fan=3), set()
    for batch in range(10):
        keys = [(f"k{n}", days[n % 2]) for n in range(batch * 5, batch * 5 + 12)]
        own = spark.createDataFrame(keys, "_key string, _day string")
        for _ in range(1 + (batch % 7 == 3)):
            got = {tuple(r) for r in store.admit(own, "run", batch).collect()}
            assert got == set(keys) - seen
        seen |= set(keys)
    live = store.segments.live()
    assert len(live) <= 4 and max(s["level"] for s in live) == 2
    rows = store.segments.read()
    assert rows.count() == len(seen) == rows.select("_key", "_day").distinct().count()
    others = spark.createDataFrame([(f"x{n}", days[0]) for n in range(1000)], "_key string, _day string")
    assert store.suspects(others, list(days)).count() < 200


def test_of_one_batchs_repeats_the_same_row_stays(spark, folder):
    rows = [("k", n, "2031-01-01 00:00:00") for n in range(20)]
    batch = spark.createDataFrame(rows, "key string, n int, ts string").withColumn(
        "ts", F.to_timestamp("ts"))
    kept = [streams.Unseen(batch.repartition(p), "key", "ts", folder("out"), "r", 0).rows.first().n
            for p in (1, 7)]
    assert kept[0] == kept[1]


def test_metrics_equal_the_tables(spark, sf, folder):
    source, out = folder("source"), folder("out")
    batch = tables.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.write_paced_files(batch.union(batch), source, 800, "alert_id")
    stream = stream_alerts(spark, source, 1, batch.schema, "parquet")
    run = streams.start_results(stream, enriched, out, folder("state"), once=True, key="alert_id")
    run.awaitTermination()
    metrics = {r.batch_id: r for r in streams.batch_metrics(spark, out).collect()}
    written = {r.batch_id: r["count"] for r in
               spark.read.parquet(out).groupBy("batch_id").count().collect()}
    assert {b: r.written for b, r in metrics.items() if r.written} == written
    assert all(r.polled == r.repeats + r.written for r in metrics.values())
    assert sum(r.polled for r in metrics.values()) == 2000


def test_rolling_windows_take_late_alerts(spark, folder):
    """A window is read before and after a late alert; its start is out and its end is in."""
    source, out, state = folder("source"), folder("panes"), folder("state")

    def deliver(*rows):
        frame = spark.createDataFrame(rows, "id string, severity string, ts string")
        frame = frame.withColumn("ts", F.to_timestamp("ts"))
        frame.write.mode("append").parquet(source)
        run = panes.start_rolling_counts(
            stream_alerts(spark, source, None, frame.schema, "parquet"), out, state, once=True, key="id")
        run.awaitTermination()

    at = [datetime(2031, 5, 2, 10), datetime(2031, 5, 2, 10, 1), datetime(2031, 5, 4)]

    def read():
        return [(r.total, r.critical, r.low) for r in
                panes.rolling_counts(spark, out, at).orderBy("as_of").collect()]

    deliver(("a", "low", "2031-05-01 10:00:00"), ("b", "low", "2031-05-01 10:00:01"),
            ("c", "critical", "2031-05-02 10:00:00"), ("d", "critical", "2031-05-02 10:00:01"),
            ("n", "low", None))
    assert read() == [(2, 1, 1), (2, 2, 0), (0, 0, 0)]
    deliver(("e", "low", "2031-05-02 09:00:00"), ("c", "critical", "2031-05-02 10:00:00"))
    assert read() == [(3, 1, 2), (3, 2, 1), (0, 0, 0)]


def test_fixed_delay_waits_after_each_run(spark, folder):
    """A run starts no sooner than the delay after the one before has ended; a halt ends the rounds."""
    source, out, state, halt = folder("source"), folder("out"), folder("state"), threading.Event()
    spans = []

    def start():
        spark.range(len(spans), len(spans) + 1).write.mode("append").parquet(source)
        began = time.monotonic()
        run = streams.start_results(stream_alerts(spark, source, None, spark.range(1).schema, "parquet"),
                                    lambda b: b, out, state, once=True)
        run.awaitTermination()
        spans.append((began, time.monotonic()))
        if len(spans) == 2:
            halt.set()
        return run

    assert streams.repeat(start, 1.5, halt) == 2
    assert spans[1][0] - spans[0][1] >= 1.5 and spark.read.parquet(out).count() == 2
    assert streams.repeat(start, 0, halt) == 0


def test_interval_trigger_and_stop(spark, folder):
    source, out = folder("source"), folder("out")
    line = '{"id": "1", "timestamp": "2031-07-09T05:06:07.250+0000", "full_log": "x 8.8.8.8"}'
    spark.createDataFrame([(line,), (line,)], "value string").write.text(source)
    alerts = stream_alerts(spark, source, schema=ALERT).withColumn("key", streams.alert_key())
    alerts = alerts.withColumn("ts", F.to_timestamp("timestamp"))
    run = streams.start_results(
        alerts, lambda b: results.enrich(b, keep=("key",)), out, folder("state"), every="1 second",
        key="key")
    run.processAllAvailable()
    assert run.isActive
    streams.stop(run)
    assert not run.isActive
    rows = spark.read.parquet(out).collect()
    assert [(r.key, r.source_ip) for r in rows] == [("1", "8.8.8.8")]


def test_key_without_id(spark):
    def alert(id_, agent):
        return (id_, None, "t", ("3", "r1", None, None), None, (agent, None, None), "")

    rows = [alert(None, "a"), alert("", "a"), alert("7", "a"), alert(None, "b")]
    keys = spark.createDataFrame(rows, ALERT).select(streams.alert_key()).collect()
    first, blank, named, other = [r[0] for r in keys]
    # A blank id is part of the digest, so it is told apart from a missing one.
    assert len(first) == len(blank) == 64 and named == "7" and other not in (first, blank)


def test_paced_batches_follow_the_row_numbers(spark, folder):
    source, out = folder("rows"), folder("paced")
    rows = spark.range(95).selectExpr("id as seq", "concat('line ', id) as log")
    rows.repartition(7).write.parquet(source)
    run = streams.start_paced(spark.read.parquet(source), out, folder("state"), 20, 5,
                              every="200 milliseconds")
    while run.isActive and (run.lastProgress or {"batchId": 0})["batchId"] < 6:
        run.awaitTermination(1)
    streams.stop(run)
    got = {(r.batch_id, r.seq) for r in spark.read.parquet(out).collect()}
    assert got == {(n // 20, n) for n in range(95)}


def test_daily_counts_over_batches(spark, sf, folder):
    source, out = folder("source"), folder("counts")
    scored = results.score_alerts(tables.alerts(spark, sf), as_of=catalog.AS_OF, keep=KEEP)
    board = tables.dashboard_alerts(scored).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.write_paced_files(board, source, 300, "ts")
    stream = stream_alerts(spark, source, 1, board.schema, "parquet")
    run = streams.start_daily_counts(stream, out, folder("state"), once=True)
    run.awaitTermination()
    counts = streams.latest_counts(spark, out)
    want = board.groupBy(F.window("ts", "24 hours")).count().count()
    assert counts.count() == want
    assert counts.agg(F.sum("total")).first()[0] == 1000
    assert counts.agg(F.sum("critical")).first()[0] == board.filter(
        "severity = 'critical'").count()
