"""Stored state of streams: a commit log with one rising epoch, and tables made of merged segments.

Both outlive their stream. A new checkpoint, or a second stream, goes on where the log ends, and a batch
that is run again after a failure finds itself committed. An entry becomes visible by renaming a
finished file to the next epoch's name, which one writer alone can do; the other one starts over
from the entry it lost to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries that are kept, so that a reader of a slightly older epoch still finds its files.
KEPT_EPOCHS = 3
# Segments of a level that are merged into one of the next.
FAN = 8
# Rows of a file of a merged segment.
FILE_ROWS = 5_000_000


class CommitLog:
    """Numbered JSON entries in a folder; each number is taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def epochs(self) -> list[int]:
        found = self.files.globStatus(self._path("[0-9]*.json")) or []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found)

    def read(self, epoch: int) -> dict:
        stream = self.files.open(self._path(f"{epoch:020d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The newest epoch and its entry; epoch -1 and an empty one before the first."""
        known = self.epochs()
        return (known[-1], self.read(known[-1])) if known else (-1, {})

    def add(self, epoch: int, entry: dict) -> bool:
        """Take the epoch for the entry; False if another writer has it already."""
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        names = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        no_options = self.jvm.java.lang.reflect.Array.newInstance(names, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.files.makeQualified(draft).toUri(), self.conf)
        try:
            # Without the option to overwrite, the rename fails where the target exists.
            context.rename(self.files.makeQualified(draft),
                           self.files.makeQualified(self._path(f"{epoch:020d}.json")), no_options)
            return True
        except Exception as failure:
            if "FileAlreadyExistsException" not in str(failure):
                raise
            self.files.delete(draft, False)
            return False

    def prune(self, named: Callable[[dict], set[str]]) -> None:
        """Drop all but the last entries, and the folders beside the log that only those name."""
        known = self.epochs()
        old, kept = known[:-KEPT_EPOCHS], known[-KEPT_EPOCHS:]
        if not old:
            return
        still = set().union(*[named(self.read(e)) for e in kept])
        for epoch in old:
            for folder in named(self.read(epoch)) - still:
                self.drop(folder)
            self.files.delete(self._path(f"{epoch:020d}.json"), False)

    def drop(self, folder: str) -> None:
        """Remove a folder that lies beside the log's own."""
        self.files.delete(self.jvm.org.apache.hadoop.fs.Path(self._path("").getParent(), folder), True)


def merges(levels: list[int], fan: int = FAN) -> list[int] | None:
    """Places of the segments to merge next, of one level; None if every level is below ``fan``."""
    for level in sorted(set(levels)):
        same = [i for i, own in enumerate(levels) if own == level]
        if len(same) >= fan:
            return same[:fan]
    return None


class Segments:
    """Rows that batches add, as segments that are merged level by level.

    ``fan`` segments of a level become one of the next, so after n batches there are at most
    (fan - 1) * (1 + log n / log fan) of them, and each row is written again once a level.
    Rows carry a ``_day``, which partitions a segment. ``fold`` combines the rows of merged segments
    (counts are added up); without it they are kept as they are. ``beside`` writes what goes
    with a segment, given its rows and their number a day.
    """

    def __init__(
        self, spark: SparkSession, path: str, shape: str, fan: int = FAN,
        fold: Callable[[DataFrame], DataFrame] | None = None,
        beside: Callable[[DataFrame, dict[str, int], str], None] | None = None,
    ):
        self.spark, self.path, self.shape, self.fan = spark, path, shape, fan
        self.fold, self.beside = fold, beside
        self.log = CommitLog(spark, f"{path}/log")

    def live(self) -> list[dict]:
        return self.log.latest()[1].get("segments", [])

    def done(self, run: str, batch: int) -> bool:
        """Whether the batch of this run is in."""
        return self.log.latest()[1].get("runs", {}).get(run, -1) >= batch

    def _read(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.shape)
        paths = [f"{self.path}/{s['name']}/rows" for s in segments]
        # Folders of several segments have no common root, so each is read with its own.
        parts = [self.spark.read.schema(self.shape).parquet(p) for p in paths]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    def read(self, days: list[str] | None = None, names: set[str] | None = None) -> DataFrame:
        """All rows, or those of the given days, from the segments (of ``names``) that have such days."""
        chosen = [s for s in self.live() if names is None or s["name"] in names]
        chosen = [s for s in chosen if days is None or not set(days).isdisjoint(s["days"])]
        rows = self._read(chosen)
        return rows if days is None else rows.filter(F.col("_day").isin(days))

    def _write(self, rows: DataFrame, level: int) -> dict:
        """A new segment with its rows a day. Files of merged ones hold ranges of a day's rows, so a
        large day is several tasks' work."""
        name = f"segment-{uuid.uuid4().hex}"
        target = f"{self.path}/{name}/rows"
        names = [c for c in rows.columns if c != "_day"]
        if level:
            rows = rows.repartitionByRange("_day", names[0]).sortWithinPartitions("_day", names[0])
        else:
            # A batch's own rows are few for the tasks that hold them: one file a day.
            rows = rows.repartition("_day")
        rows.write.partitionBy("_day").option("maxRecordsPerFile", FILE_ROWS).parquet(target)
        written = self.spark.read.schema(self.shape).parquet(target)
        days = {r["_day"]: r["count"] for r in written.groupBy("_day").count().collect()}
        if self.beside and days:
            self.beside(written, days, f"{self.path}/{name}")
        return {"name": name, "level": level, "days": days}

    def add(self, rows: DataFrame, run: str, batch: int) -> None:
        """Commit a batch's rows once, and merge the levels it fills."""
        while not self.done(run, batch):
            epoch, state = self.log.latest()
            segments = list(state.get("segments", []))
            made = [self._write(rows, 0)]
            segments += [s for s in made if s["days"]]
            while chosen := merges([s["level"] for s in segments], self.fan):
                level = segments[chosen[0]]["level"] + 1
                joined = self._read([segments[i] for i in chosen])
                made.append(self._write(self.fold(joined) if self.fold else joined, level))
                segments = [s for i, s in enumerate(segments) if i not in chosen] + [made[-1]]
            runs = {**state.get("runs", {}), run: batch}
            won = self.log.add(epoch + 1, {"runs": runs, "segments": segments})
            # What was merged at once, or lost the race, is named by no entry.
            live = {s["name"] for s in segments} if won else set()
            for segment in made:
                if segment["name"] not in live:
                    self.log.drop(segment["name"])
            self.log.prune(lambda e: {s["name"] for s in e.get("segments", [])})
