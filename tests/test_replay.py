import random

import pytest

from emberwatch.operators import replay
from emberwatch.schemas import RAW_LOG
from emberwatch.sources.logs import ORDER_COLUMNS, read_log_csv, with_file_order


def by_hand(rows, category, limit):
    """The reading loop in its plainest form: chosen numbers, and rows passed over."""
    chosen, skipped = [], 0
    for seq, _, kind in rows:
        if limit and len(chosen) >= limit:
            break
        if category and kind != category:
            skipped += 1
            continue
        chosen.append(seq)
    return chosen, skipped


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, f"line {i}", rng.choice(["a", "b", "c", None])) for i in range(400)]


@pytest.mark.parametrize("category", ["a", "zz", None, ""])
@pytest.mark.parametrize("limit, top", [
    (-1, 0), (0, 0), (1, 100), (37, 100), (100, 100), (5000, 10_000), (37, 0), (5000, 0),
])
def test_selection_and_counters(spark, rows, category, limit, top):
    df = spark.createDataFrame(rows, "seq long, log string, category string").repartition(5)
    chosen, skipped = by_hand(rows, category, limit) if limit >= 0 else ([], 0)
    got = replay.select_replay(df, category, limit, top=top).select("seq").collect()
    assert sorted(r.seq for r in got) == chosen
    assert tuple(replay.count_replay(df, category, limit, top=top).first()) == (len(chosen), skipped)


def test_the_edge_chunk_is_cut_until_it_is_small(spark, rows):
    """With few keys to a chunk, and one key that half of the rows share."""
    many = [(n // 2 if n < 400 else 150, f"x{n % 3}", "a") for n in range(800)]
    df = spark.createDataFrame(many, "seq long, log string, category string").repartition(6)
    places = replay._places(df, "a", ["seq"], None)
    keys = sorted(r[0] for r in places.select("_key").collect())
    for limit in (299, 500):
        cut = replay._cut(places, limit, keys=5).first()
        assert cut["_key"] == keys[limit - 1]
        assert cut["copies"] == keys[:limit].count(keys[limit - 1])
    assert replay._cut(places, 801, keys=5) is None


@pytest.mark.parametrize("top", [replay.TOP_ROWS, 0])
def test_ties_and_text_orders(spark, top):
    """Tied rows are taken in one order by both operators; equal rows count each."""
    texts = ["b", "a", "c", "a", None, "b", "b"] * 5
    rows = [(t, f"line {i % 4}", "x" if i % 3 else "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "at string, log string, category string").repartition(3)
    for limit in (1, 10, 22):
        got = replay.select_replay(df, "x", limit, ["at"], top=top).collect()
        counts = replay.count_replay(df, "x", limit, ["at"], top=top).first()
        assert len(got) == counts.injected == min(limit, sum(k == "x" for _, _, k in rows))
        want = sorted((r for r in rows if r[2] == "x"), key=lambda r: (r[0] is not None, r[0] or ""))
        assert sorted(str(r.at) for r in got) == sorted(str(r[0]) for r in want[: len(got)])


def test_absent_columns(spark):
    df = spark.range(3).withColumnRenamed("id", "seq")
    assert replay.select_replay(df, None, 2).count() == 2
    assert replay.select_replay(df, "a", 2).count() == 0
    assert tuple(replay.count_replay(df, "a", 2).first()) == (0, 3)
    assert {tuple(r) for r in replay.replay_lines(df).collect()} == {("unknown", "", "", "")}


def test_csv_file_order(spark, folder):
    path = folder("feed")
    lines = [(f"n{i}", "a" if i % 3 else "b") for i in range(300)]
    spark.createDataFrame(lines, RAW_LOG).coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        ordered = with_file_order(read_log_csv(spark, path))
        chosen = replay.select_replay(ordered, "b", 20, ORDER_COLUMNS, ORDER_COLUMNS[:2], 0)
        assert sorted(r.log for r in chosen.collect()) == sorted(f"n{3 * i}" for i in range(20))
        counts = replay.count_replay(ordered, "b", 20, ORDER_COLUMNS, ORDER_COLUMNS[:2], 0).first()
        assert tuple(counts) == (20, 38)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_escaped_and_appended(spark, folder):
    path = folder("lines")
    df = spark.createDataFrame([('say "hi" ' + "x" * 120, "a"), (None, None)], RAW_LOG)
    lines = replay.replay_lines(df)
    replay.write_lines(lines, path)
    replay.write_lines(lines, path)
    seen = [r.value for r in spark.read.text(path).collect()]
    assert len(seen) == 4 and 'say \\"hi\\" ' + "x" * 120 in seen
    row = lines.filter("category = 'a'").first()
    assert (len(row.shown), len(row.dry_run)) == (80, 100)
    assert {r.category for r in lines.collect()} == {"a", None}
