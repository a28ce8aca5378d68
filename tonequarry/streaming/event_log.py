"""Recorder events of an append-only log as a data source, for streams and batches.

``spark.dataSource.register(RecorderLog)``, then ``spark.readStream.format("recorder_log").option("path", folder).load()``. The folder holds
files of JSON lines ``{"recorder": .., "at": seconds, "frame": {..}}``, one frame of the recorder's socket in each. An offset
is the bytes of whole lines of each file, so a restart reads on where the last committed batch ended and a batch that is run again
reads the same bytes. A line that is no event of a recorder is passed over; one that is no JSON comes as a row with its error.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "recorder string, ts timestamp, seq long, state string, path string, error string"
#: Bytes of a file that one task reads.
PART_BYTES = 16 << 20
_KNOWN = ("started", "starting", "stopping", "stopped")


class LogRange(InputPartition):
    def __init__(self, name: str, first: int, last: int):
        self.name, self.first, self.last = name, first, last


class _Log:
    def __init__(self, options: dict):
        self.folder, self.part_bytes = options["path"], int(options.get("partBytes", PART_BYTES))

    def store(self):
        from pyarrow import fs

        path = self.folder
        return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def ends(self) -> dict[str, int]:
        """Bytes of whole lines of each file; the rest of a line that is being written is left for later."""
        from pyarrow import fs

        store, base = self.store()
        out = {}
        for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.is_file and f.size:
                with store.open_input_file(f.path) as src:
                    at = f.size
                    while at > 0:
                        low = max(0, at - 65536)
                        src.seek(low)
                        cut = src.read(at - low).rfind(b"\n")
                        if cut >= 0:
                            out[f.base_name] = low + cut + 1
                            break
                        at = low
        return out

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[LogRange]:
        """Stretches of about ``part_bytes``; lines belong to the stretch in which they begin."""
        return [LogRange(n, at, min(at + self.part_bytes, last)) for n, last in sorted(end.items()) for at in range(start.get(n, 0), last, self.part_bytes)]

    def read(self, part: LogRange) -> Iterator[tuple]:
        store, base = self.store()
        with store.open_input_file(f"{base}/{part.name}") as src:
            size, at = src.size(), part.first
            if at:  # the line that goes on from before is another stretch's
                src.seek(at - 1)
                at -= 1
                while (block := src.read(65536)) and (cut := block.find(b"\n")) < 0:
                    at += len(block)
                at = at + cut + 1 if block else size
            src.seek(at)
            rest = b""
            while at < part.last:
                block = src.read(1 << 20)
                if not block:
                    break
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if at >= part.last:
                        return
                    row = event(line, at)
                    at += len(line) + 1
                    if row:
                        yield row


def event(line: bytes, at: int) -> tuple | None:
    """One line as a row; its place in the file is its sequence."""
    if not line.strip():
        return None
    try:
        said = json.loads(line)
        frame = said["frame"]
        frame = frame.get("d", frame)
        if frame.get("eventType") != "RecordStateChanged":
            return None
        data = frame.get("eventData") or {}
        state = str(data.get("outputState") or "").rpartition("_")[2].lower()
        ts = datetime.datetime.fromtimestamp(float(said["at"]), datetime.UTC)
        return said.get("recorder"), ts, at, state if state in _KNOWN else "other", data.get("outputPath"), None
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError) as e:
        return None, None, at, None, None, f"{type(e).__name__}: {e}"


class RecorderLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorder_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[LogRange]:
        return self.log.ranges({}, self.log.ends())

    def read(self, partition: LogRange) -> Iterator[tuple]:
        return self.log.read(partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        return self.log.ranges(start, end)

    def read(self, partition: LogRange) -> Iterator[tuple]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch: the log keeps its lines."""
