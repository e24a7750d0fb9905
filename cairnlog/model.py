"""Schemas, limits and errors of the versioned key-value log."""

from __future__ import annotations

from pyspark.sql import types as T

#: A log row: which key, its total order, the segment and place it was read from, and what it says.
KV_LOG = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("seg", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("value", T.StringType()),
    ]
)

FILE_LIMIT = 4 << 20
MEMTABLE_LIMIT = 4 << 20
BLOCK_TARGET = 8 << 10
BLOCK_MAX = 1 << 20
KEY_MAX = 16_384
VALUE_MAX = 131_072
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: Bytes of a record besides key and value.
RECORD_HEAD, RUN_HEAD, WAL_PUT_HEAD, WAL_DELETE_HEAD, HINT_HEAD = 28, 25, 29, 21, 32
TAG_DELETE, TAG_PUT = 2, 4


class KVError(Exception):
    """Any failure of the store."""


class MissingKey(KVError, KeyError):
    """A strict call named a key that is not live."""

    def __init__(self, key):
        super().__init__(f"Key not found: {key!r}")


class DataCorrupted(KVError):
    """Bytes that cannot be what was written; says where and why."""

    def __init__(self, file_path: str, offset: int, reason: str, expected=None, found=None):
        self.file_path, self.offset, self.reason, self.expected, self.found = file_path, offset, reason, expected, found
        super().__init__(f"{file_path} at {offset}: {reason} (expected {expected}, found {found})")


class SizeLimit(KVError, ValueError):
    """A key or value above the limits, refused before it is written."""


#: Reasons of a corruption report.
REASONS = ("CrcMismatch", "LengthMismatch", "BufferExceedsMaxLength", "MetadataSizeOverflow", "MetaDataSizeExceedsFileSize", "InvalidUtf8", "Other")
