"""The chunked columnar file format (magic 0x31464543), as a Spark data source "corvane_chunks" and as functions.

A file: chunk data at 64-byte aligned offsets, a footer, u32 footer length, u32 magic; all little-endian.
Footer: u8 version 1, u8 endianness 1, u32 columns; for each column u32 + name, u8 type, u32 chunks; for each chunk
u8 encoding, u64 offset, u32 rows, u32 nulls, u8 has values, smallest, largest (numbers in the column's width, text
u32 + bytes), and then for plain text u64 bytes, for a dictionary u32 + entries (u32 + bytes each), for run lengths the
dictionary and u32 runs.
Data: validity bits, then numbers; bits; u32 offsets and bytes; u32 codes; or no validity
and (u32 code, u32 length, u8 null) a run.

The source reads files and folders, and writes folders. It reads one partition a chunk, decodes with numpy into Arrow, and skips chunks by their smallest and largest
values for filters that Spark pushes down.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .zone_maps import ZoneMap

# Fixed values of the format.
MAGIC, VERSION, LITTLE, ALIGNMENT = 0x31464543, 1, 1, 64
INT32, INT64, DOUBLE, BOOL, VARCHAR = range(5)
PLAIN, DICTIONARY, RUNS = range(3)

_NUMPY = {INT32: "<i4", INT64: "<i8", DOUBLE: "<f8"}
_ARROW = {INT32: pa.int32(), INT64: pa.int64(), DOUBLE: pa.float64(), BOOL: pa.bool_(), VARCHAR: pa.string()}
_SPARK = {INT32: T.IntegerType(), INT64: T.LongType(), DOUBLE: T.DoubleType(), BOOL: T.BooleanType(), VARCHAR: T.StringType()}
_STAT = {INT32: "<i", INT64: "<q", DOUBLE: "<d", BOOL: "<B"}


class FormatError(Exception):
    pass


@dataclass
class Chunk:
    encoding: int
    offset: int
    zone: ZoneMap
    size: int = 0
    dictionary: tuple[str, ...] = ()
    runs: int = 0


@dataclass
class ChunkColumn:
    name: str
    type: int
    chunks: list[Chunk]


# ---- writing --------------------------------------------------------------------------------------------------------
def _bits(values) -> bytes:
    return np.packbits(np.asarray(values, bool), bitorder="little").tobytes()


def _text(s: str | bytes) -> bytes:
    raw = s if isinstance(s, bytes) else s.encode()
    return struct.pack("<I", len(raw)) + raw


def _write_chunk(values: list, type_: int, encoding: int) -> tuple[bytes, bytes]:
    """Data, and the footer's part after the offset."""
    present = [v for v in values if v is not None]
    valid = [v is not None for v in values]
    counts = struct.pack("<II", len(values), len(values) - len(present))
    if type_ != VARCHAR:
        lo, hi = (min(present), max(present)) if present else (0, 0)
        stats = struct.pack("<B", bool(present)) + struct.pack(_STAT[type_], lo) + struct.pack(_STAT[type_], hi)
        filled = [0 if v is None else v for v in values]
        data = _bits(filled) if type_ == BOOL else np.array(filled, _NUMPY[type_]).tobytes()
        return _bits(valid) + data, counts + stats
    raw = [b"" if v is None else v.encode() for v in values]
    real = [r for r, ok in zip(raw, valid, strict=True) if ok]
    stats = struct.pack("<B", bool(real)) + _text(min(real, default=b"")) + _text(max(real, default=b""))
    if encoding == PLAIN:
        body = b"".join(raw)
        return _bits(valid) + np.cumsum([0, *map(len, raw)]).astype("<u4").tobytes() + body, counts + stats + struct.pack("<Q", len(body))
    codes: dict[bytes, int] = {}
    own = [codes.setdefault(r, len(codes)) if ok else 0 for r, ok in zip(raw, valid, strict=True)]
    table = struct.pack("<I", len(codes)) + b"".join(map(_text, codes))
    if encoding == DICTIONARY:
        return _bits(valid) + np.array(own, "<u4").tobytes(), counts + stats + table
    runs: list[list[int]] = []
    for code, ok in zip(own, valid, strict=True):
        if runs and runs[-1][0] == code and runs[-1][2] == (not ok):
            runs[-1][1] += 1
        else:
            runs.append([code, 1, not ok])
    return b"".join(struct.pack("<IIB", *r) for r in runs), counts + stats + table + struct.pack("<I", len(runs))


def write_chunks(path: str, columns: list[tuple[str, int, list]], chunk_rows: int = 2048, encodings: dict[str, int] | None = None) -> None:
    """columns: (name, type, values with None); their lengths may differ. encodings: of text columns, by name."""
    out, footer = bytearray(), [struct.pack("<BBI", VERSION, LITTLE, len(columns))]
    for name, type_, values in columns:
        encoding = (encodings or {}).get(name, PLAIN)
        starts = range(0, len(values), chunk_rows)
        footer.append(_text(name) + struct.pack("<BI", type_, len(starts)))
        for s in starts:
            out += bytes(-len(out) % ALIGNMENT)
            data, meta = _write_chunk(values[s : s + chunk_rows], type_, encoding)
            footer.append(struct.pack("<BQ", encoding, len(out)) + meta)
            out += data
    tail = b"".join(footer)
    with open(path, "wb") as f:
        f.write(bytes(out) + tail + struct.pack("<II", len(tail), MAGIC))


# ---- reading --------------------------------------------------------------------------------------------------------
class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise FormatError("the footer is cut short")
        got = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return got if len(got) > 1 else got[0]

    def text(self) -> str:
        n = self.take("<I")
        if self.at + n > len(self.data):
            raise FormatError("the footer is cut short")
        self.at += n
        return self.data[self.at - n : self.at].decode()


def read_footer(path: str) -> list[ChunkColumn]:
    with open(path, "rb") as f:
        f.seek(0, 2)
        size = f.tell()
        if size < 8:
            raise FormatError("not a chunk file")
        f.seek(size - 8)
        length, magic = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise FormatError("bad magic")
        if length > size - 8:
            raise FormatError("bad footer length")
        f.seek(size - 8 - length)
        r = _Reader(f.read(length))
    version, endian, n = r.take("<BBI")
    if version != VERSION or endian != LITTLE:
        raise FormatError(f"version {version} or byte order {endian} is unknown")
    out = []
    for _ in range(n):
        name = r.text()
        type_, chunks = r.take("<BI")
        if type_ not in _ARROW:
            raise FormatError(f"type {type_} is unknown")
        column = ChunkColumn(name, type_, [])
        for _ in range(chunks):
            encoding, offset, rows, nulls, has = r.take("<BQIIB")
            lo, hi = (r.text(), r.text()) if type_ == VARCHAR else (r.take(_STAT[type_]), r.take(_STAT[type_]))
            chunk = Chunk(encoding, offset, ZoneMap(lo if has else None, hi if has else None, nulls, rows))
            if type_ == VARCHAR:
                if encoding == PLAIN:
                    chunk.size = r.take("<Q")
                else:
                    chunk.dictionary = tuple(r.text() for _ in range(r.take("<I")))
                    if encoding == RUNS:
                        chunk.runs = r.take("<I")
            column.chunks.append(chunk)
        out.append(column)
    return out


def read_chunk(f, column: ChunkColumn, k: int) -> pa.Array:
    """Any encoding, as a plain Arrow array."""
    c = column.chunks[k]
    n = c.zone.rows
    f.seek(c.offset)
    if column.type == VARCHAR and c.encoding == RUNS:
        runs = np.frombuffer(f.read(9 * c.runs), [("code", "<u4"), ("n", "<u4"), ("null", "u1")])
        codes, valid = np.repeat(runs["code"], runs["n"]), np.repeat(runs["null"] == 0, runs["n"])
        return pa.array(c.dictionary, pa.string()).take(pa.array(codes.astype(np.int64), mask=~valid))
    words = -(-n // 8)
    valid = np.unpackbits(np.frombuffer(f.read(words), np.uint8), count=n, bitorder="little").astype(bool)
    if column.type == BOOL:
        return pa.array(np.unpackbits(np.frombuffer(f.read(words), np.uint8), count=n, bitorder="little").astype(bool), mask=~valid)
    if column.type != VARCHAR:
        dtype = np.dtype(_NUMPY[column.type])
        return pa.array(np.frombuffer(f.read(dtype.itemsize * n), dtype), _ARROW[column.type], mask=~valid)
    if c.encoding == DICTIONARY:
        codes = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
        return pa.array(c.dictionary, pa.string()).take(pa.array(codes, mask=~valid))
    offsets = np.frombuffer(f.read(4 * (n + 1)), "<i4")
    bits = np.packbits(valid, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.string(), n, [pa.py_buffer(bits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(f.read(c.size))])


@dataclass
class _Part(InputPartition):
    k: int = 0
    file: int = 0

    def __init__(self, k: int, file: int = 0):
        self.k, self.file = k, file


class ChunkSource(DataSource):
    """spark.dataSource.register(ChunkSource); spark.read.format("corvane_chunks").load(path), a file or a folder, with option
    columns ("a, b") to read those alone; frame.write.format("corvane_chunks").mode("append").save(folder), with option
    encoding (plain, dictionary or runs) for text."""

    @classmethod
    def name(cls) -> str:
        return "corvane_chunks"

    def schema(self) -> T.StructType:
        columns = {c.name: c for c in read_footer(files_of(self.options["path"])[0])}
        return T.StructType([T.StructField(n, _SPARK[columns[n].type]) for n in self._names() or columns])

    def _names(self) -> list[str]:
        return [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], self._names() or None)

    def writer(self, schema: T.StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], schema, overwrite, {"plain": PLAIN, "dictionary": DICTIONARY, "runs": RUNS}[self.options.get("encoding", "plain").lower()])


SUFFIX = ".cef"


def files_of(path: str) -> list[str]:
    """The chunk files of a folder, or the file itself."""
    path = path.removeprefix("file://")
    if not os.path.isdir(path):
        return [path]
    found = sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(SUFFIX))
    if not found:
        raise FormatError("the folder has no chunk files")
    return found


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class ChunkWriter(DataSourceArrowWriter):
    """Each task writes files of at most FILE_ROWS rows under hidden names; the driver shows them when all are done. The
    folder must be one that all machines see."""

    FILE_ROWS = 64 * 2048

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, encoding: int):
        self.path, self.overwrite, self.encoding = path.removeprefix("file://"), overwrite, encoding
        kinds = {type(v): k for k, v in _SPARK.items()}
        for f in schema.fields:
            if type(f.dataType) not in kinds:
                raise FormatError(f"column {f.name} of type {f.dataType.simpleString()} can't be stored")
        self.columns = [(f.name, kinds[type(f.dataType)]) for f in schema.fields]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        files: list[str] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            values = [[x for b in held for x in b.column(k).to_pylist()] for k in range(len(self.columns))]
            files.append(f"part-{uuid.uuid4().hex}{SUFFIX}")
            encodings = {n: self.encoding for n, t in self.columns if t == VARCHAR}
            write_chunks(f"{self.path}/.{files[-1]}", [(n, t, v) for (n, t), v in zip(self.columns, values, strict=True)], 2048, encodings)
            held.clear()

        for batch in batches:
            while batch.num_rows:
                room = self.FILE_ROWS - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == self.FILE_ROWS:
                    flush()
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        old = [f for f in os.listdir(self.path) if f.endswith(SUFFIX) and not f.startswith(".")] if self.overwrite and os.path.isdir(self.path) else []
        new = [f for m in messages if m for f in m.files]
        if not new and not (os.path.isdir(self.path) and set(os.listdir(self.path)) - set(old)):
            os.makedirs(self.path, exist_ok=True)  # no rows: a file with the columns alone
            new = [f"part-{uuid.uuid4().hex}{SUFFIX}"]
            write_chunks(f"{self.path}/.{new[0]}", [(n, t, []) for n, t in self.columns])
        for f in new:
            os.rename(f"{self.path}/.{f}", f"{self.path}/{f}")
        for f in old:
            os.remove(f"{self.path}/{f}")

    def abort(self, messages: list[_Written | None]) -> None:
        for f in [f for m in messages if m for f in m.files]:
            with suppress(FileNotFoundError):
                os.remove(f"{self.path}/.{f}")


class ChunkReader(DataSourceReader):
    TESTS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}

    def __init__(self, path: str, names: list[str] | None = None):
        """names: the columns to read, in this order; all if None."""
        self.files = []
        for f in files_of(path):
            columns = read_footer(f)
            if len({tuple(z.zone.rows for z in c.chunks) for c in columns}) > 1:
                raise FormatError("columns have different chunks")
            self.files.append((f, [{c.name: c for c in columns}[n] for n in names] if names else columns))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            op = self.TESTS.get(type(f))
            if op and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], op, f.value))
            yield f  # chunks only; Spark still tests rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, (_, columns) in enumerate(self.files):
            zones = {c.name: [k.zone for k in c.chunks] for c in columns}
            n = len(columns[0].chunks) if columns else 0
            out += [_Part(k, i) for k in range(n) if all(zones[c][k].may_match(op, v) for c, op, v in self.tests)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        path, columns = self.files[partition.file]
        with open(path, "rb") as f:
            arrays = [read_chunk(f, c, partition.k) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.name for c in columns])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
