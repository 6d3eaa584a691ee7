from pyspark.sql import functions as F

from emberwatch.sources import recent

SHAPE = "id string, ts string"


def put(spark, path, name, *rows):
    frame = spark.createDataFrame(rows, SHAPE).withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(f"{path}/day={name}")


def newest(spark, path, index, limit):
    got = recent.newest_from_files(spark, path, index, limit)
    return [r.id for r in got.collect()], len(recent.files_of_newest(recent._read(spark, index), limit))


def test_only_files_that_can_matter_are_read(spark, folder):
    path, index = folder("days"), folder("index")
    for day in range(1, 10):
        put(spark, path, f"d{day}", *[(f"{day}-{h}", f"2031-01-0{day} 0{h}:00:00") for h in range(4)])
    assert newest(spark, path, index, 3) == (["9-3", "9-2", "9-1"], 1)
    assert newest(spark, path, index, 6) == (["9-3", "9-2", "9-1", "9-0", "8-3", "8-2"], 2)
    # A late file that reaches into the newest hour is found by the next search, an old one is not read.
    put(spark, path, "late", ("late", "2031-01-09 02:30:00"), ("old", "2031-01-01 00:00:00"))
    put(spark, path, "older", ("older", "2030-01-01 00:00:00"))
    assert newest(spark, path, index, 3) == (["9-3", "late", "9-2"], 2)
    assert recent._read(spark, index).count() == 11
    got, files = newest(spark, path, index, 1000)
    assert len(got) == 39 and files == 11


def test_ties_and_rows_without_a_time(spark, folder):
    path, index = folder("days"), folder("index")
    put(spark, path, "a", ("1", "2031-01-01 00:00:00"), ("2", "2031-01-01 00:00:00"), ("n", None))
    put(spark, path, "b", ("3", "2031-01-01 00:00:00"))
    assert newest(spark, path, index, 2)[0] == ["3", "2"]
    assert newest(spark, path, index, 9)[0] == ["3", "2", "1", "n"]
