"""Little-endian numbers, record bytes and checksums as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.model import TAG_PUT


def little(n: Column, size: int = 8) -> Column:
    """A whole number as `size` little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def from_little(b: Column, start: int | Column, size: int = 8) -> Column:
    """The number in `size` little-endian bytes of b from `start` (1-based), as decimal: eight bytes can exceed a long."""
    start = F.lit(start) if isinstance(start, int) else start
    digits = F.hex(F.substring(b, start, F.lit(size)))
    turned = _let(digits, lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def size_of(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def data_body(tstamp: Column, key: Column, value: Column) -> Column:
    """What the checksum of a data record covers."""
    return F.concat(little(tstamp), little(size_of(key)), little(size_of(value)), key.cast("binary"), value.cast("binary"))


def data_record(tstamp: Column, key: Column, value: Column) -> Column:
    body = data_body(tstamp, key, value)
    return F.concat(little(F.crc32(body), 4), body)


def hint_record(key: Column, tstamp: Column, value_size: Column, value_pos: Column) -> Column:
    return F.concat(little(size_of(key)), key.cast("binary"), little(tstamp), little(value_size), little(value_pos))


def wal_record(deleted: Column, tstamp: Column, key: Column, value: Column) -> Column:
    """A put (tag 4) or a delete (tag 2), followed by the checksum of all before it."""
    put = F.concat(F.lit(b"\x04"), little(tstamp), little(size_of(key)), little(size_of(value)), key.cast("binary"), value.cast("binary"))
    delete = F.concat(F.lit(b"\x02"), little(tstamp), little(size_of(key)), key.cast("binary"))
    body = F.when(deleted, delete).otherwise(put)
    return F.concat(body, little(F.crc32(body), 4))


def run_record(tstamp: Column, deleted: Column, key: Column, value: Column) -> Column:
    flag = F.when(deleted, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return F.concat(little(tstamp), little(size_of(key)), little(size_of(value)), flag, key.cast("binary"), value.cast("binary"))


#: What `wal_decoded` gives of a record; sizes beyond a long are the largest long, and unchecked.
WAL_FIELDS = "n int, tag int, tstamp long, key_size long, value_size long, key binary, value binary, crc_ok boolean"


def wal_decoded(records: DataFrame, column: str) -> DataFrame:
    """WAL_FIELDS of every WAL record in a binary column, read from the bytes of whole Arrow batches.

    Key and value are as much as the record has; the caller compares sizes. A null record is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = b.column(0).fill_null(b"").cast(pa.large_binary())
            m, offsets = len(records), np.frombuffer(records.buffers()[1], np.int64, len(records) + 1 + records.offset)[records.offset :]
            data = np.frombuffer(records.buffers()[2], np.uint8) if m and records.buffers()[2] is not None else np.empty(0, np.uint8)
            start, n = offsets[:-1], np.diff(offsets)
            data = np.append(data, np.zeros(32, np.uint8))  # what a short record lacks reads as zeros

            def number(at: np.ndarray, size: int = 8, data=data, start=start, n=n) -> np.ndarray:
                digits = data[np.minimum(start + at, len(data) - 9)[:, None] + np.arange(size)].astype(np.uint64)
                digits[at[:, None] + np.arange(size) >= n[:, None]] = 0
                return (digits << np.arange(0, 8 * size, 8, dtype=np.uint64)).sum(1, dtype=np.uint64)

            fixed = lambda at, m=m: np.full(m, at, np.int64)
            tag = number(fixed(0), 1).astype(np.int64)
            put = tag == TAG_PUT
            long = lambda x: np.minimum(x, np.uint64(2**63 - 1)).astype(np.int64)
            tstamp, k, v = number(fixed(1)).view(np.int64), long(number(fixed(9))), np.where(put, long(number(fixed(17))), 0)
            head = np.where(put, 25, 17)
            crc = number(np.maximum(0, n - 4), 4)
            keys, values, ok = [], [], []
            for i, (at, size) in enumerate(zip(start.tolist(), n.tolist())):
                raw = data[at : at + size].tobytes()
                h, ke = int(head[i]), int(head[i] + min(k[i], size))
                keys.append(raw[h:ke])
                values.append(raw[ke : ke + min(int(v[i]), size)] if put[i] else None)
                ok.append(size >= 4 and zlib.crc32(raw[:-4]) == crc[i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(n.astype(np.int32)), pa.array(tag.astype(np.int32)), pa.array(tstamp), pa.array(k), pa.array(v),
                    pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(ok, pa.bool_()),
                ],
                [f.split()[0] for f in WAL_FIELDS.split(", ")],
            )

    return records.select(column).mapInArrow(run, WAL_FIELDS)
