"""A folder of raw files as a store: opening it, reading values where they lie, merging it, and turning WALs into runs.

Versions are ordered by file number, then by offset. Merging and flushing change several files; what is to be
done is first written down in a journal (`.journal`), and whoever opens the folder next finishes it, so a
writer that stops half way loses and revives nothing. One writer at a time; readers may be many.
"""

from __future__ import annotations

import json
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.model import FILE_LIMIT, DataCorrupted
from cairnlog.operators.resolve import newest
from cairnlog.sources.rawlog import RawLogSource, file_number, in_order, names_in, neighbours
from cairnlog.sources.sstable import RunSource

JOURNAL = ".journal"


def _read(spark: SparkSession, path: str, kind: str, mode: str, values: bool = True) -> DataFrame:
    spark.dataSource.register(RawLogSource)
    return spark.read.format("rawlog").options(path=path, kind=kind, mode=mode, values=str(values).lower()).load()


def finish(path: str) -> None:
    """Do what a journal says, if there is one: old files go, oldest first, and hidden new ones get their names."""
    journal = os.path.join(path, JOURNAL)
    if not os.path.exists(journal):
        return
    with open(journal) as f:
        todo = json.load(f)
    for name in todo["old"]:
        if os.path.exists(old := os.path.join(path, name)):
            os.remove(old)
    for hidden, name in todo["new"]:
        if os.path.exists(new := os.path.join(path, hidden)):
            os.replace(new, os.path.join(path, name))
    os.remove(journal)


def _begin(path: str, old: list[str], new: list[tuple[str, str]]) -> None:
    with open(os.path.join(path, f"{JOURNAL}.tmp"), "w") as f:
        json.dump({"old": old, "new": new}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(os.path.join(path, f"{JOURNAL}.tmp"), os.path.join(path, JOURNAL))


def opened(spark: SparkSession, path: str, mode: str = "truncate") -> DataFrame:
    """The key directory of a folder: key, file (the data file), value_pos, value_sz and tstamp of every live key.

    Files that have hints are read by them. An empty value is a delete, as records have no flag.
    """
    finish(path)
    found = newest(_read(spark, path, "keys", mode), ["key"], ["seq"]).where("value_sz > 0")
    return found.select("key", F.regexp_replace("file", r"\.hint$", ".data").alias("file"), "value_pos", "value_sz", "tstamp")


def values_at(directory: DataFrame) -> DataFrame:
    """The rows of a key directory with `value`, read from its place in its file; files are read in order of place."""
    return _values(directory.sortWithinPartitions("file", "value_pos"))


def _values(where: DataFrame, checked: bool = False) -> DataFrame:
    """The rows of a key directory, in their order, with `value`. checked: whole records are read, and their checksums looked at."""

    def run(batches):
        name, f = None, None
        for b in batches:
            out = []
            for key, file, at, n in zip(*(b.column(c).to_pylist() for c in ("key", "file", "value_pos", "value_sz"))):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, open(file, "rb")  # noqa: SIM115
                before = 28 + len(key) if checked else 0
                f.seek(at - before)
                got = f.read(before + n)
                if checked and zlib.crc32(got[4:]) != int.from_bytes(got[:4], "little"):
                    raise DataCorrupted(file, at - before, "CrcMismatch")
                out.append(got[before:])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "value"])
        if f:
            f.close()

    return where.mapInArrow(run, T.StructType([*where.schema.fields, T.StructField("value", T.BinaryType())]))


def merge(spark: SparkSession, path: str, limit: int = FILE_LIMIT) -> None:
    """Rewrite all files but the newest to the records that are live, with hints; every record's checksum is looked at.

    A bad record fails the merge, and nothing is changed then. The new files take the last of the old ones' numbers,
    so that the newest file stays the newest. Files are of about `limit` bytes, larger if there were fewer old ones.
    Keys are resolved without values; the files are then divided among tasks, in their order, and each reads and writes what is live in its own.
    """
    finish(path)
    numbered = [n for n in names_in(path, "data") if file_number(n) is not None]
    if len(numbered) < 2:
        return
    names = names_in(path, "data")
    place, old = names.index(numbered[-1]), [n for n in names if n != numbered[-1]]
    rows = _read(spark, path, "data", "failfast", values=False)
    live = newest(rows.select("key", "seq", "deleted", "tstamp", "value_pos", "value_sz", "seg"), ["key"], ["seq"])
    live = live.where(F.col("seg") != place).where("NOT deleted")
    sizes = [os.path.getsize(os.path.join(path, n)) for n in old]
    tasks = neighbours(sizes)
    # a task ends with a file that may be small: that many fewer are left for whole ones, as there are no more numbers than old files
    target = max(limit, -(-sum(sizes) // (len(old) - len(tasks) + 1)))
    staging = os.path.join(path, ".merge")
    for name in os.listdir(staging) if os.path.isdir(staging) else ():
        os.remove(os.path.join(staging, name))  # of a merge that was given up
    segs = {n: i for i, n in enumerate(names)}
    files = [(segs[old[i]], os.path.join(path, old[i]), t) for t, group in enumerate(tasks) for i in group]
    live = live.join(F.broadcast(spark.createDataFrame(files, "seg long, file string, task int")), "seg")
    kept = _values(live.repartitionById(len(tasks), "task").sortWithinPartitions("seq"), checked=True).select("key", "value", "deleted", "tstamp")
    kept.write.format("rawlog").mode("append").options(path=staging, hints="true", limit=1 << 62, target=target).save()
    made = names_in(staging, "data") if os.path.isdir(staging) else []
    new = []
    for name, to in zip(made, in_order(old)[len(old) - len(made) :]):
        for kind in ("data", "hint"):
            new.append((os.path.join(".merge", f"{name.rsplit('.', 1)[0]}.{kind}"), f"{to.rsplit('.', 1)[0]}.{kind}"))
    hints = {n for n in os.listdir(path) if n.endswith(".hint")}
    _begin(path, [x for n in old for x in (f"{n[:-5]}.hint", n) if x == n or x in hints], new)
    finish(path)


def flush_wals(spark: SparkSession, path: str, runs: str, mode: str = "truncate") -> int:
    """Turn every WAL in a folder into a sorted run of the folder `runs`, and remove it; how many there were.

    A run has the last entry of each key, tombstones too, and takes a number after those that are there, in the
    order of the WALs. A bad record ends its WAL, as on any replay. The WALs go once all runs are written.
    """
    finish(path)
    names = names_in(path, "wal")
    if not names:
        return 0
    os.makedirs(runs, exist_ok=True)
    spark.dataSource.register(RunSource)
    first = max((n for x in os.listdir(runs) if (n := file_number(x)) is not None), default=-1) + 1
    # a task reads whole WALs: sorting within it is enough
    rows = _read(spark, path, "wal", mode).select("key", "value", "deleted", "tstamp", (F.col("seg") + first).alias("run"), "seq")
    rows = rows.sortWithinPartitions("run", "key", F.desc("seq")).drop("seq")
    rows.write.format("runs").mode("append").options(path=runs, repeats="first").save()
    _begin(path, names, [])
    finish(path)
    return len(names)
