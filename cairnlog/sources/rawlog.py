"""Raw log files as Spark sources: `.data`, `.hint` and `.wal` files of binary records.

    spark.dataSource.register(RawLogSource)
    spark.read.format("rawlog").option("path", folder).option("kind", "data").load()

Kinds are `data`, `hint` and `wal`; `keys` reads every file's hints where it has any, else its data, without
values: what opening a folder needs; the option `values` set to false leaves values out of other kinds too. Small files
that follow each other share a partition, a file is never split, and all are read record by record in bounded buffers.
`mode` says what a bad record does: `truncate` ends its file and keeps what came before, `failfast`
raises DataCorrupted, and `report` gives it as a row with its reason; a key that isn't UTF-8 is a bad record
of a data or hint file. Files are ordered by the number in their name, other names first. The folder must be
visible to the executors as a path; `read_files` reads one in any store that Spark reads.

Writing appends: every file gets a number after all that the folder has, and none is ever replaced. Data files
get their hint files beside them if the option `hints` is true. `limit` is the most bytes of a file; with `target`
a file ends once it has that many.
"""

from __future__ import annotations

import io
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cairnlog.model import FILE_LIMIT, KEY_MAX, TAG_DELETE, TAG_PUT, VALUE_MAX, DataCorrupted, SizeLimit

SCHEMA = "file string, seg long, pos long, seq long, tstamp long, key binary, value binary, deleted boolean, value_pos long, value_sz long, reason string"


KINDS = ("data", "hint", "wal")
#: Bytes of files that a task reads, and bytes that opening a file counts for.
SPLIT, OPEN_COST = 8 << 20, 16 << 10
#: Most rows of an Arrow batch, and bytes of keys and values from which it ends.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def new_timestamp() -> int:
    """Nanoseconds since 1970."""
    return time.time_ns()


def file_number(name: str) -> int | None:
    stem = os.path.basename(name).rsplit(".", 1)[0]
    return int(stem) if stem.isdecimal() and stem.isascii() else None


def in_order(names: list[str]) -> list[str]:
    """By the number in the name; names without one come first."""
    return sorted(names, key=lambda n: ((f := file_number(n)) is not None, f or 0, n))


def encode_data(tstamp: int, key: bytes, value: bytes) -> bytes:
    body = struct.pack("<QQQ", tstamp, len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def encode_hint(key: bytes, tstamp: int, value_size: int, value_pos: int) -> bytes:
    return struct.pack("<Q", len(key)) + key + struct.pack("<QQQ", tstamp, value_size, value_pos)


def encode_wal(tstamp: int, key: bytes, value: bytes | None) -> bytes:
    if value is None:
        body = struct.pack("<BQQ", TAG_DELETE, tstamp, len(key)) + key
    else:
        body = struct.pack("<BQQQ", TAG_PUT, tstamp, len(key), len(value)) + key + value
    return body + struct.pack("<I", zlib.crc32(body))


def _exactly(f, n: int, left: int) -> bytes | None:
    """n bytes, or None where the file has fewer: sizes are compared before anything is read."""
    return f.read(n) if n <= left else None


def _utf8(key: bytes) -> bool:
    try:
        key.decode()
        return True
    except UnicodeDecodeError:
        return False


def decode(f, size: int, kind: str) -> Iterator[tuple]:
    """(pos, tstamp, key, value, deleted, value_pos, value_sz, reason) of each record; after a reason there is no more."""
    pos = 0
    while pos < size:
        left = size - pos
        bad = lambda why: (pos, None, None, None, None, None, None, why)  # noqa: B023, E731
        if kind == "data":
            head = _exactly(f, 28, left)
            if head is None:
                yield bad("LengthMismatch")
                return
            crc, tstamp, k, v = struct.unpack("<IQQQ", head)
            rest = _exactly(f, k + v, left - 28)
            if rest is None:
                yield bad("MetaDataSizeExceedsFileSize")
                return
            if zlib.crc32(rest, zlib.crc32(head[4:])) != crc:
                yield bad("CrcMismatch")
                return
            if not _utf8(rest[:k]):
                yield bad("InvalidUtf8")
                return
            yield pos, tstamp, rest[:k], rest[k:], v == 0, pos + 28 + k, v, None
            pos += 28 + k + v
        elif kind == "hint":
            head = _exactly(f, 8, left)
            k = struct.unpack("<Q", head)[0] if head else 0
            rest = _exactly(f, k + 24, left - 8) if head else None
            if rest is None:
                yield bad("LengthMismatch" if head is None else "MetaDataSizeExceedsFileSize")
                return
            tstamp, v, at = struct.unpack("<QQQ", rest[k:])
            if not _utf8(rest[:k]):
                yield bad("InvalidUtf8")
                return
            yield pos, tstamp, rest[:k], None, False, at, v, None
            pos += 32 + k
        elif kind == "wal":
            head = _exactly(f, 17, left)
            if head is None:
                yield bad("LengthMismatch")
                return
            tag, tstamp, k = struct.unpack("<BQQ", head)
            if tag not in (TAG_PUT, TAG_DELETE):
                yield bad("UnknownTag")
                return
            v = 0
            if tag == TAG_PUT:
                more = _exactly(f, 8, left - 17)
                if more is None:
                    yield bad("LengthMismatch")
                    return
                v, head = struct.unpack("<Q", more)[0], head + more
            if k > KEY_MAX or v > VALUE_MAX:
                yield bad("KeyTooLong" if k > KEY_MAX else "ValueTooLong")
                return
            rest = _exactly(f, k + v + 4, left - len(head))
            if rest is None:
                yield bad("MetaDataSizeExceedsFileSize")
                return
            if zlib.crc32(rest[:-4], zlib.crc32(head)) != struct.unpack("<I", rest[-4:])[0]:
                yield bad("CrcMismatch")
                return
            yield pos, tstamp, rest[:k], rest[k:-4] if tag == TAG_PUT else None, tag == TAG_DELETE, pos + len(head) + k, v, None
            pos += len(head) + len(rest)
        else:
            raise ValueError(f"no such kind of file: {kind}")


def names_in(path: str, kind: str) -> list[str]:
    """The files of a kind in order; of kind `keys`, for each stem its hint file if there is one, else its data file."""
    names = [n for n in os.listdir(path) if not n.startswith(".")]
    if kind != "keys":
        return in_order([n for n in names if n.endswith(f".{kind}")])
    hints = {n.rsplit(".", 1)[0] for n in names if n.endswith(".hint")}
    stems = {n.rsplit(".", 1)[0] for n in names if n.endswith(".data")}
    return in_order([f"{s}.hint" if s in hints else f"{s}.data" for s in stems])


def neighbours(sizes: list[int], most: int = SPLIT) -> list[range]:
    """Places of files of these sizes in groups of about `most` bytes: only files that follow each other, each in one group."""
    out, first, filled = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and filled + n + OPEN_COST > most:
            out.append(range(first, i))
            first, filled = i, 0
        filled += n + OPEN_COST
    return [*out, range(first, len(sizes))] if sizes else []


def batches_of(rows: Iterable[tuple], schema: pa.Schema, sized: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, bounded by rows and by the bytes of the columns `sized`."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        for i in sized:
            size += len(row[i] or b"")
        if len(some) == BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def publish(folder: str, made: list[list[str]]) -> list[str]:
    """Give groups of finished hidden files their names: a new number for each group, and none is replaced.

    A group is files `.<anything>.<kind>` of one stem. Linking fails where a name is taken, by another writer too; the next number is tried then.
    """
    numbers = [n for x in os.listdir(folder) if not x.startswith(".") and (n := file_number(x)) is not None]
    number, out = max(numbers, default=-1) + 1, []
    for group in made:
        while True:
            names, done = [os.path.join(folder, f"{number}.{g.rsplit('.', 1)[1]}") for g in group], []
            number += 1
            try:
                for old, new in zip(group, names):
                    os.link(old, new)
                    done.append(new)
                break
            except FileExistsError:
                for n in done:
                    os.remove(n)
        for old in group:
            os.remove(old)
        out += names
    return out


class Files(InputPartition):
    """Files by name and place among all."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files

    @staticmethod
    def of(path: str, names: list[str]) -> list[Files]:
        """Files of a folder, in their order, as partitions."""
        full = [os.path.join(path, n) for n in names]
        return [Files([(full[i], i) for i in group]) for group in neighbours([os.path.getsize(n) for n in full])]


def rows_of(f, name: str, size: int, seg: int, kind: str, mode: str, values: bool = True) -> Iterator[tuple]:
    """The rows of one file by SCHEMA."""
    for pos, tstamp, key, value, deleted, at, v, why in decode(f, size, kind):
        if why and mode == "failfast":
            raise DataCorrupted(name, pos, why)
        if why and mode == "truncate":
            return
        # the order of versions is the file's place, then the offset in it
        yield name, seg, pos, (seg << 40) | pos, tstamp, key, value if values else None, deleted, at, v, why


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.mode = options["path"], options.get("kind", "data"), options.get("mode", "truncate")
        self.values = self.kind != "keys" and options.get("values", "true").lower() == "true"
        if self.kind not in (*KINDS, "keys"):
            raise ValueError(f"no such kind of file: {self.kind}")

    def partitions(self):
        return Files.of(self.path, names_in(self.path, self.kind))

    def _rows(self, partition: Files) -> Iterator[tuple]:
        for name, seg in partition.files:
            kind = self.kind if self.kind != "keys" else name.rsplit(".", 1)[1]
            with open(name, "rb", buffering=1 << 20) as f:
                yield from rows_of(f, name, os.path.getsize(name), seg, kind, self.mode, self.values)

    def read(self, partition: Files):
        return batches_of(self._rows(partition), arrow_schema(SCHEMA), (5, 6))


def read_files(spark: SparkSession, path: str, kind: str = "data", mode: str = "truncate") -> DataFrame:
    """The rows of all files of a kind in a folder of any store that Spark reads; a file at a time is held as a whole."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of file: {kind}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    place = {n: i for i, n in enumerate(in_order([r[0] for r in files.select("path").collect()]))}  # a row a file

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                found = list(rows_of(io.BytesIO(content), name, len(content), place[name], kind, mode))
                yield pd.DataFrame(found, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"tstamp": "Int64", "value_pos": "Int64", "value_sz": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


class _Commit(WriterCommitMessage):
    def __init__(self, groups: list[list[str]]):
        self.groups = groups


class _Writer(DataSourceArrowWriter):
    """Appends rows (key, value, deleted, tstamp), or hints (key, tstamp, value_sz, value_pos), as files of at most `limit`
    bytes, except for one larger record. With `target`, every file of a task but its last has at least so many bytes."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.limit = options["path"], options.get("kind", "data"), int(options.get("limit", FILE_LIMIT))
        self.target = int(options.get("target", self.limit))
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of file: {self.kind}")
        self.hints = self.kind == "data" and options.get("hints", "false").lower() == "true"
        needed = ("key", "tstamp", "value_sz", "value_pos") if self.kind == "hint" else ("key", "tstamp", "value", "deleted")
        self.at = [schema.fieldNames().index(n) for n in needed]

    def _record(self, row) -> tuple[bytes, bytes, int, int]:
        """The record, its key, time and size of value."""
        key, tstamp, a, b = row
        if self.kind == "hint":
            return encode_hint(key, tstamp, a, b), key, tstamp, a
        value = None if b else a or b""
        if self.kind == "wal":
            if len(key) > KEY_MAX or len(value or b"") > VALUE_MAX:
                raise SizeLimit(f"key of {len(key)} or value of {len(value or b'')} bytes is above the limit")
            return encode_wal(tstamp, key, value), key, tstamp, len(value or b"")
        return encode_data(tstamp, key, value or b""), key, tstamp, len(value or b"")

    def write(self, batches):
        os.makedirs(self.path, exist_ok=True)
        groups, files, size = [], [], 0

        def end() -> None:
            for f in files:
                f.flush()
                os.fsync(f.fileno())
                f.close()

        for row in (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in self.at))):
            out, key, tstamp, n = self._record(row)
            if not files or size and (size + len(out) > self.limit or size >= self.target):
                end()
                stem = os.path.join(self.path, f".{uuid.uuid4().hex}")
                groups.append([f"{stem}.{self.kind}", *([f"{stem}.hint"] if self.hints else [])])
                files, size = [open(g, "wb") for g in groups[-1]], 0  # noqa: SIM115
            if self.hints:
                files[1].write(encode_hint(key, tstamp, n, size + 28 + len(key)))
            files[0].write(out)
            size += len(out)
        end()
        return _Commit(groups)

    def commit(self, messages):
        publish(self.path, [g for m in messages if m for g in m.groups])

    def abort(self, messages):
        for n in [n for m in messages if m for g in m.groups for n in g]:
            if os.path.exists(n):
                os.remove(n)


class RawLogSource(DataSource):
    @classmethod
    def name(cls):
        return "rawlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are only ever appended")
        return _Writer(dict(self.options), schema)
