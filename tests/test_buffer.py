from collections import deque

import pytest

from emberwatch.operators.buffer import append_events, recent_events
from emberwatch.streaming import alerts as streams

ORDER = [("batch_id", True), ("ts", False)]


def polled(spark, batches, size):
    rows = [(b, t) for b in range(batches) for t in range(size)]
    return spark.createDataFrame(rows, "batch_id long, ts int").repartition(4)


@pytest.mark.parametrize("limit", [100, 1, 0, -1, -480, -600, 900])
def test_pages_are_list_slices(spark, limit):
    """Insertion order is poll by poll, newest first within one."""
    kept = deque(maxlen=500)
    for b in range(30):
        kept.extend((b, t) for t in reversed(range(25)))
    page = recent_events(polled(spark, 30, 25), ORDER, limit)
    assert [(r.batch_id, r.ts) for r in page.collect()] == list(kept)[-limit:]


def test_append_keeps_duplicates(spark):
    batch = polled(spark, 1, 3)
    assert append_events(batch, batch).count() == 6


def test_epochs_of_the_written_buffer(spark, folder):
    path = folder("buffer")
    order = [("ts", False)]
    kept = deque(maxlen=50)
    batches = [spark.range(n).selectExpr("cast(id as int) as ts") for n in (20, 70, 5, 10)]
    streams.create_buffer(batches[0], path)
    streams.create_buffer(batches[0], path)
    assert streams.read_buffer(spark, path, order, 0, 50).count() == 0
    for number, batch in enumerate(batches):
        streams.update_buffer(batch, "run", number, path, order, 50)
        # The empty buffer is epoch 0.
        kept.extend((number + 1, t) for t in reversed(range(batch.count())))
    # A batch that runs again finds itself committed.
    streams.update_buffer(batches[3], "run", 3, path, order, 50)
    rows = streams.read_buffer(spark, path, order, 0, 50).collect()
    assert [(r.epoch, r.ts) for r in rows] == list(kept)
