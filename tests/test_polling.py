import json

from pyspark.sql import functions as F

from emberwatch.sources import polling
from emberwatch.streaming import alerts as streams


def alert(number):
    return json.dumps({"id": str(number), "timestamp": "2032-01-02T03:04:05.000+0000",
                       "full_log": f"gate {number} closed"})


def put(spark, path, numbers):
    """One more file of alerts; with a blank line, which is no alert."""
    lines = [alert(n) for n in numbers]
    rows = spark.createDataFrame([(x,) for x in [*lines[:3], "", *lines[3:]]], "value string")
    rows.coalesce(1).write.mode("append").text(path)


def polled(spark, source, state, out, rows=10):
    """Runs the poll until nothing is left; sizes and ids of its batches."""
    stream = polling.poll_alerts(spark, source, f"{state}/ledger", f"{state}/checkpoint", rows)
    run = streams.start_results(stream.withColumn("ts", F.to_timestamp("timestamp")),
                                lambda b: b.select("id"), out, f"{state}/checkpoint", every="0 seconds")
    run.processAllAvailable()
    streams.stop(run)
    found = spark.read.parquet(out).orderBy("run", "batch_id", F.col("id").cast("int")).collect()
    batches = {}
    for r in found:
        batches.setdefault((r.run, r.batch_id), []).append(int(r.id))
    return list(batches.values())


def test_a_file_is_taken_in_parts(spark, folder):
    source = folder("source")
    put(spark, source, range(25))
    got = polled(spark, source, folder("state"), folder("out"))
    assert got == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_parts_go_over_files_and_restarts(spark, folder):
    source, state, out = folder("source"), folder("state"), folder("out")
    put(spark, source, range(12))
    assert polled(spark, source, state, out) == [list(range(10)), [10, 11]]
    assert polled(spark, source, state, out) == [list(range(10)), [10, 11]]
    put(spark, source, range(12, 15))
    put(spark, source, range(15, 30))
    got = polled(spark, source, state, out)
    assert [len(b) for b in got] == [10, 2, 10, 8]
    assert sorted(sum(got, [])) == list(range(30))


def test_nothing_to_poll_yet(spark, folder):
    """An empty answer is no batch, and what comes later is read."""
    source, state = folder("source"), folder("state")
    spark.createDataFrame([], "value string").write.text(source)
    stream = polling.poll_alerts(spark, source, f"{state}/ledger", f"{state}/checkpoint", 2)
    run = stream.writeStream.format("memory").queryName("polled_later").option(
        "checkpointLocation", f"{state}/checkpoint").trigger(processingTime="0 seconds").start()
    run.processAllAvailable()
    assert spark.table("polled_later").count() == 0
    put(spark, source, range(5))
    run.processAllAvailable()
    assert spark.table("polled_later").count() == 5
    streams.stop(run)


def test_byte_ranges_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(polling, "TASK_BYTES", 7)
    lines = ["a", "bb", "", "ccc" * 5, "d\r", "eé" * 4, "f"]
    (tmp_path / "x.json").write_bytes("\n".join(lines).encode())
    reader = polling.PolledReader({"path": str(tmp_path), "rows": "4", "state": str(tmp_path / "_s"),
                                   "checkpoint": str(tmp_path / "_c")})
    place, got = reader.initialOffset(), []
    for _ in range(3):
        end = dict(reader.latestOffset())
        got.append([v for part in reader.partitions(place, end)
                    for batch in reader.read(part) for v in batch.column("value").to_pylist()])
        place = end
    assert got == [["a", "bb", "ccc" * 5, "d"], ["eé" * 4, "f"], []]
