"""Checks of records: what a damaged log still gives, and a report of what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.model import BLOCK_MAX, KEY_MAX, TAG_DELETE, TAG_PUT, VALUE_MAX, DataCorrupted


def truncated(log: DataFrame, ok: Column, run: str = "seg") -> DataFrame:
    """Rows before the first bad one of each segment; other segments are not touched."""
    so_far = Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.coalesce(ok, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return log.withColumn("_ok", F.min(good).over(so_far)).where("_ok = 1").drop("_ok")


def failfast(log: DataFrame, ok: Column, run: str = "seg") -> DataFrame:
    """The log, failing at a bad row when it is read."""
    told = F.format_string("record %d of segment %d is corrupt", F.col("seq"), F.col(run))
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("seq")).otherwise(F.raise_error(told).cast("long"))
    return log.withColumn("seq", checked)


def wal_reason(tag: Column, key_size: Column, value_size: Column, rest: Column, crc_ok: Column) -> Column:
    """Why a WAL record is refused, or null. rest: bytes that the record has for key and value."""
    value = F.when(tag == TAG_PUT, value_size).otherwise(F.lit(0))
    return (
        F.when(~tag.isin(TAG_DELETE, TAG_PUT) | tag.isNull(), "UnknownTag")
        .when(key_size > KEY_MAX, "KeyTooLong")
        .when(value > VALUE_MAX, "ValueTooLong")
        .when(key_size + value > rest, "LengthMismatch")
        .when(~F.coalesce(crc_ok, F.lit(False)), "CrcMismatch")
    )


def block_reason(size: Column, head: Column, need: Column, crc_ok: Column) -> Column:
    """Why a block is refused, or null. head: bytes left for a record's header; need: bytes that its sizes ask for."""
    return (
        F.when(size > BLOCK_MAX, "BufferExceedsMaxLength")
        .when(head < 25, "LengthMismatch")
        .when(need.isNull(), "MetadataSizeOverflow")  # try_add gave nothing
        .when(need > size, "MetaDataSizeExceedsFileSize")
        .when(~F.coalesce(crc_ok, F.lit(False)), "CrcMismatch")
    )


def report(rows: DataFrame, reason: Column, expected: Column, found: Column) -> DataFrame:
    """seg, pos, reason, expected, found and message of every row that has a reason."""
    told = F.format_string("segment %s at %s: %s (expected %s, found %s)", "seg", "pos", "reason", "expected", "found")
    rows = rows.withColumns({"reason": reason, "expected": expected.cast("string"), "found": found.cast("string")})
    return rows.where("reason IS NOT NULL").select("seg", "pos", "reason", "expected", "found", told.alias("message"))


def raise_first(found: DataFrame, path: str = "") -> None:
    """DataCorrupted for the first row of a report, if there is one."""
    row = found.orderBy("seg", "pos").first()
    if row is not None:
        raise DataCorrupted(path or str(row["seg"]), row["pos"], row["reason"], row["expected"], row["found"])
