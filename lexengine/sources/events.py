"""Event streams (server-sent events) as a data source: read in batch and as a stream, and written as a stream.

Reading: the files of a folder are streams that grow at their ends.  An offset is the end of the last whole frame of each file, so
what is behind it, an unfinished frame, is read when it has been finished, once, also after a restart.  Ranges of about
``bytesPerTask`` bytes are read by a task each; a frame belongs to the task in whose range it begins.  ``maxBytesPerTrigger`` bounds
what a batch takes of each file, to whole frames.

Writing: each task writes its frames (columns event and data) to a file of its own; committing a batch writes its manifest, which
names these files.  A batch whose manifest is there already adds nothing, and files that no manifest names are no part of the output.
What was written is read by the same source, batch after batch.

A frame ends with an empty line; lines may end with a carriage return.  Rows are the raw frames; ``functions.text.sse_events`` and
``completion_deltas`` parse them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import paths

BYTES_PER_TASK = 16_000_000
#: Bytes that are read at once.
_CHUNK = 1 << 16
_BATCHES = "_batches"


@dataclass
class Range(InputPartition):
    name: str
    #: Frames that begin in [start, stop) and end at last or before.
    start: int
    stop: int
    last: int


def _ends(data: bytes, at: int) -> int:
    """Where the frame that goes on at ``at`` ends: behind its empty line; -1 if it doesn't."""
    while True:
        line = data.find(b"\n", at)
        if line < 0:
            return -1
        rest = data[line + 1 : line + 3]
        if rest[:1] == b"\n":
            return line + 2
        if rest == b"\r\n":
            return line + 3
        at = line + 1


def last_end(store, name: str, size: int, least: int = 0) -> int:
    """The end of the last whole frame in the file's first ``size`` bytes, at ``least`` or after; read from the end backwards."""
    tail, at = b"", size
    while at > least:
        start = max(least, at - _CHUNK)
        # an empty line may lie across two readings
        tail = paths.read_range(store, name, start, at - start) + tail[:3]
        found = max(tail.rfind(b"\n\n") + 2 if b"\n\n" in tail else -1, tail.rfind(b"\n\r\n") + 3 if b"\n\r\n" in tail else -1)
        if found >= 0:
            return start + found
        at = start
    return least


def first_end(store, name: str, start: int, last: int) -> int:
    """The first end of a frame behind ``start``, ``last`` at most."""
    data, at = b"", start
    while at < last:
        data += paths.read_range(store, name, at, min(_CHUNK, last - at))
        at = start + len(data)
        if (found := _ends(data, 0)) >= 0:
            return start + found
    return last


def frames(store, name: str, start: int, stop: int, last: int) -> Iterator[tuple[int, str]]:
    """(place, frame) of the frames that begin in [start, stop)."""
    data, base, at = b"", start, start
    while base + len(data) < last or data:
        end = _ends(data, at - base)
        if end < 0:
            if base + len(data) >= last:
                return
            data, base = data[at - base :] + paths.read_range(store, name, base + len(data), min(_CHUNK, last - base - len(data))), at
            continue
        frame = data[at - base : end].decode("utf-8", "replace").strip("\r\n")
        if frame:
            yield at, frame
        at = base + end
        if at >= stop:
            return


def _aligned(store, name: str, at: int, start: int, last: int) -> int:
    """The beginning of the first frame at ``at`` or behind, in a range that begins with one."""
    found = max(start, at - 3) if at > start else at
    while found < at:
        found = first_end(store, name, found, last)
    return found


def ranges(store, name: str, start: int, last: int, step: int) -> Iterator[Range]:
    """Parts of [start, last) of about ``step`` bytes, each beginning with a frame."""
    at = start
    while at < last:
        stop = last if last - at <= step else _aligned(store, name, at + step, start, last)
        yield Range(name, at, stop, last)
        at = stop


def streams_at(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder of streams; of a written one, those that its manifests name, in order."""
    batches = f"{path.rstrip('/')}/{_BATCHES}"
    manifests = paths.listed(batches, ".json")
    if not manifests:
        return paths.listed(path)
    _, folder = paths.opened(path.rstrip("/"))
    out = []
    for name, _ in sorted(manifests, key=lambda m: int(m[0].rpartition("/")[2].removesuffix(".json"))):
        out += [(f"{folder}/{f['file']}", f["bytes"]) for f in json.loads(paths.read_text(f"{batches}/{name.rpartition('/')[2]}"))]
    return out


def _rows(path: str, part: Range) -> Iterator[tuple[str, int, str]]:
    store, _ = paths.opened(path)
    for at, frame in frames(store, part.name, part.start, part.stop, part.last):
        yield part.name, at, frame


class EventReader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self) -> list[Range]:
        store, _ = paths.opened(self.path)
        out = [r for name, size in streams_at(self.path) for r in ranges(store, name, 0, last_end(store, name, size), self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, partition)


class EventStreamReader(DataSourceStreamReader):
    """Offsets are {file: end of the last whole frame taken}."""

    def __init__(self, path: str, step: int, most: int | None) -> None:
        self.path, self.step, self.most = path, step, most
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = paths.opened(self.path)
        for name, size in streams_at(self.path):
            begun = self.reached.get(name, 0)
            end = last_end(store, name, size, begun)
            if self.most and end - begun > self.most:
                # at least one frame, and as many more as the bound lets in
                end = max(last_end(store, name, begun + self.most, begun), first_end(store, name, begun, end))
            self.reached[name] = end
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # after a restart this is how the reader learns what has been taken
        self.reached = {k: max(v, self.reached.get(k, 0)) for k, v in (self.reached | end).items()}
        store, _ = paths.opened(self.path)
        out = [r for name, last in sorted(end.items()) for r in ranges(store, name, start.get(name, 0), last, self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    bytes: int


class EventWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        name = f"{uuid.uuid4().hex}.sse"

        def made() -> Iterator[bytes]:
            for batch in iterator:
                for event, data in zip(batch.column("event").to_pylist(), batch.column("data").to_pylist()):
                    head = f"event: {event}\n" if event else ""
                    # data of several lines has a field for each
                    body = "".join(f"data: {line}\n" for line in (data or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
                    yield f"{head}{body}\n".encode()

        return Written(context.partitionId(), name, paths.write_bytes(f"{self.path}/{name}", made()))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        manifest = f"{self.path}/{_BATCHES}/{batchId}.json"
        if paths.read_text(manifest) is not None:
            self.abort(messages, batchId)
            return
        files = sorted((m for m in messages if m is not None and m.bytes), key=lambda m: m.partition)
        # written beside and moved, so that a manifest is whole or absent
        begun = f"{self.path}/{_BATCHES}/.{uuid.uuid4().hex}"
        paths.write_bytes(begun, [json.dumps([{"file": m.file, "bytes": m.bytes} for m in files]).encode()])
        store, at = paths.opened(begun)
        store.move(at, paths.opened(manifest)[1])
        self.abort([m for m in messages if m is not None and not m.bytes], batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            if m is not None:
                paths.removed(f"{self.path}/{m.file}")


class EventSource(DataSource):
    """Format "sse": read and readStream with path, bytesPerTask and maxBytesPerTrigger; writeStream with path."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "file string, at bigint, frame string"

    def _step(self) -> int:
        return int(self.options.get("bytesPerTask", BYTES_PER_TASK))

    def reader(self, schema: StructType) -> EventReader:
        return EventReader(self.options["path"], self._step())

    def streamReader(self, schema: StructType) -> EventStreamReader:
        most = self.options.get("maxBytesPerTrigger")
        return EventStreamReader(self.options["path"], self._step(), int(most) if most else None)

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:
        if not {"event", "data"} <= set(schema.names):
            raise ValueError("event streams are written from the columns event and data")
        return EventWriter(self.options["path"])


def read_frames(spark: SparkSession, path: str, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """file, at and frame of the whole frames that are there."""
    spark.dataSource.register(EventSource)
    return spark.read.format("sse").option("bytesPerTask", bytes_per_task).load(path)


def stream_frames(spark: SparkSession, path: str, bytes_per_task: int = BYTES_PER_TASK, most_bytes: int | None = None) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(EventSource)
    reader = spark.readStream.format("sse").option("bytesPerTask", bytes_per_task)
    return (reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader).load(path)


def write_frames(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what a stream of (event, data) rows has so far, each batch once, in the order of its partitions."""
    rows.sparkSession.dataSource.register(EventSource)
    rows.writeStream.format("sse").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
