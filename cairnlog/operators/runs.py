"""Sorted runs: how the log is cut into them, what they hold, and what is known of them without reading them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.functions.binary import size_of
from cairnlog.functions.scan import running_total
from cairnlog.model import BLOCK_TARGET, FILE_LIMIT, MEMTABLE_LIMIT, RECORD_HEAD, RUN_HEAD
from cairnlog.operators.resolve import newest


def runs_by_count(log: DataFrame, ops: int) -> DataFrame:
    """The log with `run`: its operations in order of seq, so many to a run."""
    counted = running_total(log, "seq", F.lit(1), "_before")
    return counted.withColumn("run", F.floor(F.col("_before") / ops).cast("long")).drop("_before")


def runs_by_bytes(log: DataFrame, limit: int = MEMTABLE_LIMIT) -> DataFrame:
    """The log with `run`: a new one begins with the first operation after each multiple of `limit` bytes of keys and values."""
    counted = running_total(log, "seq", size_of(F.col("key")) + size_of(F.col("value")), "_before")
    return counted.withColumn("run", F.floor(F.col("_before") / limit).cast("long")).drop("_before")


def flushed(log: DataFrame, run: str = "seg") -> DataFrame:
    """What the runs hold: the last entry of each key in each run, tombstones among them."""
    return newest(log, [run, "key"], ["seq"])


def sorted_runs(log: DataFrame, partitions: int, run: str = "seg") -> DataFrame:
    """Runs laid out for writing: key ranges across files, sorted by key inside."""
    return flushed(log, run).repartitionByRange(partitions, run, "key").sortWithinPartitions(run, "key")


def manifest(entries: DataFrame, run: str = "seg") -> DataFrame:
    """run, n, n_del, min_key and max_key; keys compare as unsigned bytes."""
    return entries.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("n_del"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def tiered(entries: DataFrame, run: str = "seg") -> DataFrame:
    """Live pairs as a tiered read finds them: the newest run with a key decides, and its tombstone hides older runs."""
    return newest(entries, ["key"], [run, "seq"]).where(~F.col("deleted"))


def _greedy(rows: DataFrame, run: str, order: str, size: Column, limit: int, after: bool, out: str) -> DataFrame:
    """(run, order, bytes, out, offset) of every row, cut one after another within each run; `out` counts from 0.

    after: a piece ends with the row that takes it over the limit; else before a row that would. Where the
    next piece begins depends on all before it, so a run, which its writer bounded, is one task's work: that of
    its sizes alone, a search for each piece.
    """
    sizes = rows.select(run, order, size.cast("long").alias("bytes"))
    fields = [*sizes.schema.fields, T.StructField(out, T.LongType()), T.StructField("offset", T.LongType())]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ends = np.cumsum(pdf["bytes"].to_numpy())
        starts, at = [0], 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            last = int(np.searchsorted(ends, before + limit, "right"))  # the first that takes it over
            at = last + 1 if after else max(last, at + 1)
            starts.append(at)
        piece = np.searchsorted(starts, np.arange(len(ends)), "right") - 1
        begin = np.array([0, *ends])[np.array(starts)[piece]]
        return pdf.assign(**{out: piece, "offset": ends - pdf["bytes"].to_numpy() - begin})

    return sizes.groupBy(run).applyInPandas(cut, T.StructType(fields))


def block_cuts(entries: DataFrame, limit: int = BLOCK_TARGET, run: str = "seg") -> DataFrame:
    """run, key, bytes, block and offset of every entry: in key order, a block ends with the record that takes it over the limit."""
    return _greedy(entries, run, "key", RUN_HEAD + size_of(F.col("key")) + size_of(F.col("value")), limit, True, "block")


def blocks(entries: DataFrame, limit: int = BLOCK_TARGET, run: str = "seg") -> DataFrame:
    """Entries with their bytes, block and offset; each (run, key) is there once."""
    return entries.join(block_cuts(entries, limit, run), [run, "key"])


def sparse_index(cut: DataFrame, run: str = "seg") -> DataFrame:
    """run, block, start_key, n and bytes of every block, from `block_cuts`."""
    return cut.groupBy(run, "block").agg(
        F.min("key").alias("start_key"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )


def files(log: DataFrame, limit: int = FILE_LIMIT, run: str = "seg") -> DataFrame:
    """run, seq, bytes, `file` and offset of log rows: a file is closed before a record that would take it over the limit."""
    return _greedy(log, run, "seq", RECORD_HEAD + size_of(F.col("key")) + size_of(F.col("value")), limit, False, "file")


def floor_block(index: DataFrame, probes: DataFrame, run: str = "seg") -> DataFrame:
    """run, key, block, start_key: for every probe (run, key) the block with the greatest start at or below the key, if any."""
    starts = index.select(run, F.col("start_key").alias("k"), F.struct("block", "start_key").alias("b"), F.lit(0).alias("side"))
    asked = probes.select(run, F.col("key").alias("k"), F.lit(None).cast(starts.schema["b"].dataType).alias("b"), F.lit(1).alias("side"))
    seen = F.last("b", True).over(Window.partitionBy(run).orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0))
    got = starts.unionByName(asked).withColumn("hit", seen).where("side = 1")
    return got.select(run, F.col("k").alias("key"), F.col("hit.block").alias("block"), F.col("hit.start_key").alias("start_key"))


#: Key ranges that candidates meet in, and probes that their bounds are taken from, for each.
RANGES, SAMPLED = 64, 64


def candidates(runs: DataFrame, probes: DataFrame, run: str = "seg") -> DataFrame:
    """(key, run): runs whose key range holds the probe.

    Keys are cut into ranges at quantiles of a bounded sample of the probes. A run meets the probes of each
    range that it reaches into, so the join is by range, on either side of any size.
    """
    asked = probes.select("key").where("key IS NOT NULL").distinct()
    some = asked.orderBy(F.xxhash64("key"), "key").limit(RANGES * SAMPLED).collect()
    keys = sorted((r[0] for r in some), key=lambda k: k.encode() if isinstance(k, str) else bytes(k))
    cuts = F.array(*map(F.lit, keys[:: max(1, len(keys) // RANGES)])) if keys else F.array().cast("array<string>")
    place = lambda key: F.size(F.filter(cuts, lambda c: c <= key))
    spread = runs.select(run, "min_key", "max_key", F.explode(F.sequence(place(F.col("min_key")), place(F.col("max_key")))).alias("_range"))
    met = asked.withColumn("_range", place(F.col("key"))).join(spread, "_range")
    return met.where(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", run)
