"""Alerts polled from folders of JSON lines, a given number at a time.

Spark's file source caps a batch by files; here a poll takes the next N alerts, wherever in a file they
end. An offset is a place: the number of a file and a byte in it. Finding the place N alerts
ahead reads just these lines; tasks then read byte ranges. Files count in the order they were first seen, which
a ledger keeps, so a file that turns up late or with an old time is neither missed nor read twice. Files
are complete once they can be seen, as with Spark's own file source; names that start with ``_`` or
``.`` are left out. Blank lines are no alerts.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberwatch.schemas import ALERT

FORMAT = "polled_lines"
# Bytes of a file that one task reads.
TASK_BYTES = 16 * 1024 * 1024
BATCH_LINES = 10_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    local = path.removeprefix("file:") if path.startswith("file:") else path
    if local.startswith("/"):
        return pafs.LocalFileSystem(), "/" + local.strip("/")
    return pafs.FileSystem.from_uri(path)


def _listed(store: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    chosen = pafs.FileSelector(root, allow_not_found=True, recursive=True)
    return [f for f in store.get_file_info(chosen) if f.type == pafs.FileType.File]


class LineRange(InputPartition):
    """Lines that start at ``first`` or behind and before ``end``; ``first`` may lie inside a line."""

    def __init__(self, path: str, first: int, end: int, cut: bool):
        self.path, self.first, self.end, self.cut = path, first, end, cut


class Ledger:
    """The files in the order they were first seen, one small file for each time some were."""

    def __init__(self, path: str):
        self.store, self.root = _open(path)
        self.store.create_dir(self.root, recursive=True)
        self.names: list[str] = []
        self.parts = 0
        for info in sorted(_listed(self.store, self.root), key=lambda f: f.path):
            if info.base_name.startswith("files-"):
                with self.store.open_input_stream(info.path) as stream:
                    self.names += json.loads(stream.read())
                self.parts += 1

    def add(self, names: list[str]) -> None:
        draft, name = f"{self.root}/_draft", f"{self.root}/files-{self.parts:012d}"
        with self.store.open_output_stream(draft) as stream:
            stream.write(json.dumps(names).encode())
        self.store.move(draft, name)
        self.names += names
        self.parts += 1


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.source, self.rows = options["path"], int(options["rows"])
        self.state, self.checkpoint = options["state"], options["checkpoint"]
        self.ledger: Ledger | None = None
        self.place: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": 0, "at": 0}

    def _planned(self) -> dict:
        """The end of the newest batch a checkpoint knows; Spark does not tell it on a restart."""
        store, root = _open(f"{self.checkpoint.rstrip('/')}/offsets")
        known = [f for f in _listed(store, root) if f.base_name.isdigit()]
        if not known:
            return self.initialOffset()
        with store.open_input_stream(max(known, key=lambda f: int(f.base_name)).path) as stream:
            return json.loads(stream.read().decode().splitlines()[-1])

    def _discover(self) -> None:
        if self.ledger is None:
            self.ledger = Ledger(self.state)
        store, root = _open(self.source)
        known = set(self.ledger.names)
        new = [f for f in _listed(store, root) if f.path not in known and not any(
            part.startswith(("_", ".")) for part in f.path.removeprefix(root).split("/"))]
        if new:
            new.sort(key=lambda f: (f.mtime_ns or 0, f.path))
            self.ledger.add([f.path for f in new])

    def latestOffset(self) -> dict:
        """The place at most ``rows`` alerts behind the last one."""
        if self.place is None:
            self.place = self._planned()
        self._discover()
        store, _ = _open(self.source)
        number, at, left = self.place["file"], self.place["at"], self.rows
        while left and number < len(self.ledger.names):
            with store.open_input_file(self.ledger.names[number]) as file:
                file.seek(at)
                lines = io.BufferedReader(file)
                while left and (line := lines.readline()):
                    at += len(line)
                    left -= bool(line.strip())
                ended = not left and not lines.readline()
            if (left or ended) and number + 1 < len(self.ledger.names):
                number, at = number + 1, 0
            else:
                break
        self.place = {"file": number, "at": at}
        return self.place

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        if self.ledger is None:
            self.ledger = Ledger(self.state)
        store, _ = _open(self.source)
        ranges = []
        for number in range(start["file"], min(end["file"], len(self.ledger.names) - 1) + 1):
            path = self.ledger.names[number]
            first = start["at"] if number == start["file"] else 0
            last = end["at"] if number == end["file"] else store.get_file_info(path).size
            for low in range(first, last, TASK_BYTES):
                ranges.append(LineRange(path, low, min(low + TASK_BYTES, last), low > first))
        return ranges

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.source)
        with store.open_input_file(partition.path) as file:
            # From inside a file, the byte before tells whether a line starts right here.
            at = partition.first - partition.cut
            file.seek(at)
            lines = io.BufferedReader(file)
            if partition.cut:
                at += len(lines.readline())
            held = []
            while at < partition.end and (line := lines.readline()):
                at += len(line)
                if line.strip():
                    held.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(held) == BATCH_LINES:
                    yield pa.RecordBatch.from_pydict({"value": held})
                    held = []
            if held:
                yield pa.RecordBatch.from_pydict({"value": held})


class PolledLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> PolledReader:
        return PolledReader(self.options)


def poll_lines(
    spark: SparkSession, path: str, rows: int, state: str, checkpoint: str
) -> DataFrame:
    """Lines below ``path`` as a stream of at most ``rows`` a batch.

    ``state`` keeps the ledger; ``checkpoint`` is the folder the query of this stream is started with.
    """
    spark.dataSource.register(PolledLines)
    options = {"path": path, "rows": str(rows), "state": state, "checkpoint": checkpoint}
    return spark.readStream.format(FORMAT).options(**options).load()


def poll_alerts(
    spark: SparkSession, path: str, state: str, checkpoint: str, rows: int = 10
) -> DataFrame:
    """Alerts below ``path``, at most ``rows`` a batch; a line that is no JSON fails the query."""
    alert = F.from_json("value", ALERT, {"mode": "FAILFAST"}).alias("alert")
    return poll_lines(spark, path, rows, state, checkpoint).select(alert).select("alert.*")
