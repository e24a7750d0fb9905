"""Segments, the key directory, compaction and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.functions.binary import size_of
from cairnlog.model import RECORD_HEAD
from cairnlog.operators.resolve import latest, live
from cairnlog.operators.verify import failfast


def record_bytes() -> Column:
    return RECORD_HEAD + size_of(F.col("key")) + size_of(F.col("value"))


def positioned(log: DataFrame, run: str = "seg") -> DataFrame:
    """The log with `pos`, the byte offset of each record in its segment."""
    before = Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("pos", F.coalesce(F.sum(record_bytes()).over(before), F.lit(0)).cast("long"))


def directory(placed: DataFrame) -> DataFrame:
    """key, seg, value_pos, value_sz and tstamp of every live key: where its value lies."""
    return live(placed).select(
        "key", "seg", (RECORD_HEAD + F.col("pos") + size_of(F.col("key"))).alias("value_pos"), size_of(F.col("value")).alias("value_sz"),
        F.col("seq").alias("tstamp"),
    )


def immutable(log: DataFrame) -> DataFrame:
    """All but the active segment, which is the newest."""
    newest = log.agg(F.max("seg").alias("_active"))
    return log.join(F.broadcast(newest), F.col("seg") < F.col("_active")).drop("_active")  # one row


def merged(log: DataFrame, ok: Column | None = None) -> DataFrame:
    """Rows of immutable segments that a merge keeps: those that are their key's live version.

    A tombstone goes too, as resolution has looked at every segment and no older version is left. ok: whether
    a row's checksum is right; a merge of a damaged log fails.
    """
    log = log if ok is None else failfast(log, ok)
    return immutable(log).join(live(log).select("key", "seq"), ["key", "seq"], "left_semi")


def hints(log: DataFrame) -> DataFrame:
    """key, tstamp, value_sz and value_pos of the merged segments: all that recovery needs, without values."""
    out = positioned(merged(log))
    return out.select(
        "seg", "key", F.col("seq").alias("tstamp"), size_of(F.col("value")).alias("value_sz"),
        (RECORD_HEAD + F.col("pos") + size_of(F.col("key"))).alias("value_pos"),
    )


def dead_space(log: DataFrame) -> DataFrame:
    """seg, rows, live_rows, bytes and live_bytes of every segment."""
    alive = live(log).select("key", "seq", F.lit(True).alias("_live"))
    rows = log.join(alive, ["key", "seq"], "left").withColumn("_n", record_bytes())
    return rows.groupBy("seg").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_live").alias("live_rows"), F.sum("_n").alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("_live"), F.col("_n"))), F.lit(0)).alias("live_bytes"),
    )


def recovered(log: DataFrame) -> DataFrame:
    """key, value_sz and tstamp of live keys as found from hints of merged segments and the records of the active one."""
    active = log.join(F.broadcast(log.agg(F.max("seg").alias("seg"))), "seg")
    told = hints(log).select("key", "tstamp", "value_sz", F.lit(False).alias("deleted"))
    read = active.select("key", F.col("seq").alias("tstamp"), size_of(F.col("value")).alias("value_sz"), "deleted")
    both = told.unionByName(read).withColumnRenamed("tstamp", "seq")
    return latest(both).where(~F.col("deleted")).select("key", "value_sz", F.col("seq").alias("tstamp"))


def recovery_differences(log: DataFrame) -> DataFrame:
    """One row: keys that recovery misses or makes up against the full log; both must be 0."""
    same = ["key", "value_sz", "tstamp"]
    whole = directory(positioned(log)).select(*same, F.lit(True).alias("_whole"))
    found = recovered(log).select(*same, F.lit(True).alias("_found"))
    both = whole.join(found, same, "full")
    return both.agg(F.count_if(F.col("_found").isNull()).alias("missing"), F.count_if(F.col("_whole").isNull()).alias("extra"))


def segment_order(names: DataFrame) -> DataFrame:
    """name and place (from 1): numeric names by number, others before them. The list of segments is a list of files."""
    number = F.expr("try_cast(name AS bigint)")
    return names.withColumn("place", F.row_number().over(Window.orderBy(number.asc_nulls_first(), "name")).cast("long"))
