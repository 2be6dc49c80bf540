"""A data source for arrays in npz files: rows of the members that are as long as each other, read by byte ranges.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").load("graph_embeddings.npz")     # a column for each member: terms string, embeddings array<double>

A file is a zip archive of arrays with headers. The driver reads its directory and the headers alone; each task reads its own range of
rows out of every member. Members that are compressed can't be entered in the middle, so such a file is one task's, as a stream.
Paths are those that pyarrow knows, of a file or of a folder of such files. Options: partitionBytes, what a partition reads of all
members, about; fileRows, the rows that a written file holds at most.
"""

from __future__ import annotations

import ast
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: Defaults of the options; rows that are read at once, and numbers that a written file holds at most.
PARTITION_BYTES, BATCH_ROWS, FILE_ROWS, FILE_NUMBERS = 32 << 20, 4096, 100_000, 4_000_000


@dataclass
class Member:
    """An array of a file: where its numbers begin, in the file or, if it is compressed, in what is inflated."""

    name: str
    packed: bool
    data_at: int
    skip: int
    dtype: str
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape[1:], dtype=np.int64))

    def kind(self) -> DataType:
        kind = np.dtype(self.dtype).kind
        one = {"U": StringType(), "f": DoubleType(), "i": LongType(), "u": LongType()}.get(kind)
        if one is None or len(self.shape) not in (1, 2):
            raise ValueError(f"the array {self.name!r} of {self.dtype} with {len(self.shape)} dimensions is no column")
        return one if len(self.shape) == 1 else ArrayType(one)

    def column(self, data: bytes) -> pa.Array:
        x = np.frombuffer(data, np.dtype(self.dtype)) if self.row_bytes else np.zeros(0, np.dtype(self.dtype))
        own = x.dtype.kind
        flat = pa.array(x.tolist(), pa.string()) if own == "U" else pa.array(x.astype(np.float64 if own == "f" else np.int64))
        if len(self.shape) == 1:
            return flat
        rows, width = len(data) // max(1, self.row_bytes), self.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), flat)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The npz files at a path, each as a path of its own."""
    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    found = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npz")]
    return sorted(f"{path.rstrip('/')}/{x.rsplit('/', 1)[1]}" for x in found)


def _header(data: bytes) -> tuple[str, tuple[int, ...], int]:
    """(dtype, shape, bytes before the numbers) of an array's head."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("no array")
    size, at = (struct.unpack("<H", data[8:10])[0], 10) if data[6] == 1 else (struct.unpack("<I", data[8:12])[0], 12)
    head = ast.literal_eval(data[at : at + size].decode("latin1"))
    if head["fortran_order"] and len(head["shape"]) > 1:
        raise ValueError("an array by columns")
    return head["descr"], tuple(head["shape"]), at + size


def members(path: str) -> list[Member]:
    """The arrays of a file, from its directory and their heads."""
    store, at = _store(path)
    out = []
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        for x in z.infolist():
            if x.filename.endswith(".npy"):
                with z.open(x) as member:
                    dtype, shape, skip = _header(member.read(min(x.file_size, 1 << 16)))
                f.seek(x.header_offset)
                name, extra = struct.unpack("<HH", f.read(30)[26:30])
                out.append(Member(x.filename.removesuffix(".npy"), x.compress_type != zipfile.ZIP_STORED, x.header_offset + 30 + name + extra, skip, dtype, shape))
    return out


@dataclass
class Rows(InputPartition):
    path: str
    members: list[Member]
    first: int
    last: int


class _Inflated:
    """What a compressed member holds, read from its beginning on."""

    def __init__(self, f, at: int):
        self.f, self.at, self.inflate, self.held = f, at, zlib.decompressobj(-15), b""

    def read(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n and not self.inflate.eof:
            self.f.seek(self.at)
            raw = self.inflate.unconsumed_tail or self.f.read(1 << 16)
            if not self.inflate.unconsumed_tail:
                self.at += len(raw)
            parts.append(self.inflate.decompress(raw, max(1 << 16, n - size)))
            size += len(parts[-1])
            if not raw:
                break
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int = PARTITION_BYTES):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for path in _files(self.path):
            own = {m.name: m for m in members(path)}
            wanted = [own[f.name] for f in self.schema.fields]
            if not wanted:
                continue
            n = wanted[0].shape[0]
            if any(m.shape[0] != n for m in wanted):
                raise ValueError(f"arrays of several lengths in {path}")
            step = n if any(m.packed for m in wanted) else max(1, self.partition_bytes // max(1, sum(m.row_bytes for m in wanted)))
            out += [Rows(path, wanted, k, min(n, k + step)) for k in range(0, n, max(1, step))]
        return out or [Rows("", [], 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.members:
            return
        store, at = _store(partition.path)
        with store.open_input_file(at) as f:
            streams = {}
            for m in partition.members:
                if m.packed:
                    streams[m.name] = _Inflated(f, m.data_at)
                    streams[m.name].read(m.skip)
            for first in range(partition.first, partition.last, BATCH_ROWS):
                last, columns = min(first + BATCH_ROWS, partition.last), []
                for m in partition.members:
                    size = (last - first) * m.row_bytes
                    if m.packed:
                        data = streams[m.name].read(size)
                    else:
                        f.seek(m.data_at + m.skip + first * m.row_bytes)
                        data = f.read(size)
                    columns.append(m.column(data) if m.row_bytes else m.column(b"").take(pa.array([], pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[m.name for m in partition.members])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceWriter):
    """Writes parts of bounded size into a folder, which are there once all of them are written."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, file_rows: int = FILE_ROWS):
        self.path, self.schema, self.overwrite, self.job = path.rstrip("/"), schema, overwrite, uuid.uuid4().hex
        self.file_rows = file_rows

    def write(self, rows: Iterator) -> Written:
        files: list[str] = []
        held: list[tuple] = []
        numbers = 0
        for row in rows:
            held.append(tuple(row))
            numbers += sum(len(x) if isinstance(x, list) else 1 for x in held[-1])
            if len(held) == self.file_rows or numbers >= FILE_NUMBERS:
                files.append(self._save(held))
                held, numbers = [], 0
        if held:
            files.append(self._save(held))
        return Written(files)

    def _save(self, rows: list[tuple]) -> str:
        arrays = {}
        for field, values in zip(self.schema.fields, zip(*rows, strict=True), strict=True):
            if any(v is None for v in values):
                raise ValueError(f"the column {field.name!r} has nulls, which arrays don't")
            arrays[field.name] = np.array(list(values), str if isinstance(field.dataType, StringType) else np.int64 if isinstance(field.dataType, LongType) else np.float64)
        np.savez(whole := io.BytesIO(), **arrays)
        store, at = _store(self.path)
        store.create_dir(folder := f"{at}/_writing-{self.job}", recursive=True)
        with store.open_output_stream(f"{folder}/{(name := f'part-{uuid.uuid4().hex}.npz')}") as f:
            f.write(whole.getvalue())
        return name

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npz")] if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{at}/_writing-{self.job}/{name}", f"{at}/{name}")
        for x in old:
            store.delete_file(x)
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/_writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_writing-{self.job}")


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no npz files in {self.options['path']}")
        return StructType([StructField(m.name, m.kind()) for m in members(files[0])])

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options["path"], schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], schema, overwrite, int(self.options.get("fileRows", FILE_ROWS)))
