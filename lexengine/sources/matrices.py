"""Matrices of vectors in NumPy's file format, as a data source for reading and writing.

Reading: a file, or a folder of files whose rows follow each other in the order of names.  Tasks take row ranges of about
``bytesPerTask`` bytes (64 MB unless set) and read these bytes only; headers are all that is read to plan.

Writing: each task writes the values of its rows to a shard without header, and its entries to a shard of JSON lines.  The commit
step, on the driver, writes the header of the whole matrix, the metadata, and last the manifest, which names the shards in the
order of partitions; shards of failed attempts are in no manifest and so in no matrix.  ``cat header shards...`` is a .npy file.

Matrices have two dimensions; other shapes, objects and rows of different lengths are refused.  Values are read and written as
32-bit floats.  A matrix without rows is read as no rows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import paths

MANIFEST = "_matrix.json"
HEADER = "embeddings.npy.header"
META = "meta.json"
BYTES_PER_TASK = 64_000_000
#: Rows of a batch that is handed on.
BATCH_ROWS = 4_096
#: Bytes that hold the header of any matrix.
_HEADER_BYTES = 65_536 + 12


@dataclass
class Matrix:
    """Where a file's rows are: all that its header says."""

    name: str
    rows: int
    width: int
    dtype: str
    start: int
    by_column: bool = False


@dataclass
class Rows(InputPartition):
    matrix: Matrix
    first: int
    last: int
    #: Position of the file's first row.
    pos: int


def header_of(name: str, head: bytes) -> Matrix:
    """What a .npy file's first bytes say."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if len(shape) != 2 or dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{name}: no matrix of numbers but {shape} of {dtype}")
    return Matrix(name, shape[0], shape[1], dtype.str, f.tell(), by_column)


def header_bytes(rows: int, width: int) -> bytes:
    """The header of a matrix of 32-bit floats."""
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
    return f.getvalue()


def matrices_at(path: str) -> list[Matrix]:
    """The matrices at a path, in order: the shards of a written one, else .npy files."""
    manifest = paths.read_text(f"{path.rstrip('/')}/{MANIFEST}")
    if manifest is not None:
        m = json.loads(manifest)
        _, folder = paths.opened(path.rstrip("/"))
        return [Matrix(f"{folder}/{s['values']}", s["rows"], m["embedding_dim"], "<f4", 0) for s in m["shards"]]
    store, at = paths.opened(path)
    return [header_of(name, paths.read_range(store, name, 0, _HEADER_BYTES)) for name, _ in paths.listed(path, "" if at.endswith(".npy") else ".npy")]


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, bytes_per_task: int) -> None:
        self.path, self.bytes_per_task = path, bytes_per_task

    def partitions(self) -> list[Rows]:
        out, pos = [], 0
        for m in matrices_at(self.path):
            step = max(1, self.bytes_per_task // max(1, m.width * np.dtype(m.dtype).itemsize))
            out += [Rows(m, at, min(at + step, m.rows), pos) for at in range(0, m.rows, step)]
            pos += m.rows
        return out or [Rows(Matrix("", 0, 0, "<f4", 0), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m, (store, _) = partition.matrix, paths.opened(self.path)
        dtype = np.dtype(m.dtype)
        for at in range(partition.first, partition.last, BATCH_ROWS):
            n = min(BATCH_ROWS, partition.last - at)
            if m.by_column:
                columns = [paths.read_range(store, m.name, m.start + (c * m.rows + at) * dtype.itemsize, n * dtype.itemsize) for c in range(m.width)]
                raw, shape = b"".join(columns), (m.width, n)
            else:
                raw, shape = paths.read_range(store, m.name, m.start + at * m.width * dtype.itemsize, n * m.width * dtype.itemsize), (n, m.width)
            if len(raw) < n * m.width * dtype.itemsize:
                raise ValueError(f"{m.name}: shorter than its header says")
            values = np.frombuffer(raw, dtype=dtype).reshape(shape)
            values = np.ascontiguousarray(values.T if m.by_column else values, dtype=np.float32)
            rows = np.arange(at, at + n)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m.width, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([m.name] * n, pa.string()), pa.array(rows), pa.array(partition.pos + rows), vectors], names=["file", "row", "pos", "embedding"])


@dataclass
class Shard(WriterCommitMessage):
    partition: int
    rows: int
    width: int
    values: str
    entries: str


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, meta: dict[str, str], overwrite: bool) -> None:
        self.path, self.meta, self.overwrite, self.job = path.rstrip("/"), meta, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        context = TaskContext.get()
        name = f"{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}"
        shard = Shard(context.partitionId(), 0, 0, f"{name}.f32", f"{name}.json")

        def chunks() -> Iterator[tuple[bytes, bytes]]:
            for batch in iterator:
                vectors = batch.column("embedding")
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                if not len(lengths):
                    continue
                if vectors.null_count or (lengths != (shard.width or lengths[0])).any():
                    raise ValueError("a matrix has no rows without vector, or of different lengths")
                shard.width = int(lengths[0])
                shard.rows += len(lengths)
                values = vectors.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
                # an entry's line also says which of the shard's rows is its own
                first = shard.rows - len(lengths)
                entries = [f'{{"row":{first + k}{"," if x != "{}" else ""}{x[1:]}\n' for k, x in enumerate(batch.column("entry").to_pylist())]
                yield values.astype("<f4").tobytes(), "".join(entries).encode()

        store, folder = paths.opened(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{shard.values}") as values, store.open_output_stream(f"{folder}/{shard.entries}") as entries:
            for v, e in chunks():
                values.write(v)
                entries.write(e)
        return shard

    def commit(self, messages: list[Shard | None]) -> None:
        shards = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        widths = {m.width for m in shards}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError("a matrix has no rows of different lengths")
        old = paths.read_text(f"{self.path}/{MANIFEST}")
        if old is not None and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has a matrix; it can be overwritten, not added to")
        rows, width = sum(m.rows for m in shards), widths.pop() if widths else 0
        meta = self.meta | {"num_entries": rows, "embedding_dim": width}
        paths.write_bytes(f"{self.path}/{HEADER}", [header_bytes(rows, width)])
        paths.write_bytes(f"{self.path}/{META}", [json.dumps(meta, indent=2).encode()])
        # from here on the matrix is the new one
        paths.write_bytes(f"{self.path}/{MANIFEST}", [json.dumps(meta | {"shards": [{"values": m.values, "entries": m.entries, "rows": m.rows} for m in shards]}).encode()])
        gone = [m for m in messages if m is not None and not m.rows]
        self.abort(gone)
        for s in json.loads(old)["shards"] if old else []:
            paths.removed(f"{self.path}/{s['values']}")
            paths.removed(f"{self.path}/{s['entries']}")

    def abort(self, messages: list[Shard | None]) -> None:
        for m in messages:
            if m is not None:
                paths.removed(f"{self.path}/{m.values}")
                paths.removed(f"{self.path}/{m.entries}")


class MatrixSource(DataSource):
    """spark.read.format("npy"); options path, bytesPerTask.  df.write.format("npy"); columns entry (JSON) and embedding."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row bigint, pos bigint, embedding array<float>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("bytesPerTask", BYTES_PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        if not {"entry", "embedding"} <= set(schema.names):
            raise ValueError("a matrix is written from the columns entry and embedding")
        return MatrixWriter(self.options["path"], {k: self.options.get(k, "") for k in ("model", "provider", "strategy")}, overwrite)


def read_npy(spark: SparkSession, path: str, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """file, row, pos and embedding from a .npy matrix, a folder of them, or a written one."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy").option("bytesPerTask", bytes_per_task).load(path)


def write_matrix(rows: DataFrame, path: str, model: str, provider: str, strategy: str) -> None:
    """Rows (pos, embedding and what else an entry has), in the order of pos, as a matrix with its entries and metadata."""
    rows.sparkSession.dataSource.register(MatrixSource)
    entry = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("pos", "embedding")]), {"ignoreNullFields": "false"})
    dealt = rows.repartitionByRange("pos").sortWithinPartitions("pos").select(entry.alias("entry"), "embedding")
    dealt.write.format("npy").mode("overwrite").option("model", model).option("provider", provider).option("strategy", strategy).save(path)


def read_matrix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written matrix with its entries: pos, embedding and the entries' columns, of the given schema."""
    manifest = paths.read_text(f"{path.rstrip('/')}/{MANIFEST}")
    if manifest is None:
        raise FileNotFoundError(path)
    shards = json.loads(manifest)["shards"]
    vectors = read_npy(spark, path).select(F.element_at(F.split("file", "[/.]"), -2).alias("shard"), "row", "pos", "embedding")
    if not shards:
        return vectors.drop("shard", "row").join(spark.createDataFrame([], f"pos bigint, {schema}"), "pos")
    lines = spark.read.schema(f"row bigint, {schema}").json([f"{path.rstrip('/')}/{s['entries']}" for s in shards])
    lines = lines.withColumn("shard", F.element_at(F.split("_metadata.file_path", "[/.]"), -2))
    return vectors.join(lines, ["shard", "row"]).drop("shard", "row")
