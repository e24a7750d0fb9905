"""A store on Parquet: sorted runs of the log in a folder, with the calls of an embedded key-value store.

Writes are collected and committed as one run; a commit is one Parquet write, so a reader sees all
of it or none. Reads resolve versions by seq and see what has been put but not committed yet. A run's
number is claimed by a file that can be made only once, and the versions in it are numbered from it, so of
several writers on one folder each has runs of its own and later ones win.

What has been put is committed when asked, or when flush_ops have been collected; `sync_every` makes
every put commit what is older than so many seconds (0: each put at once).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.model import KV_LOG, MissingKey
from cairnlog.operators import access, compact, runs
from cairnlog.operators.resolve import live


class Store:
    def __init__(self, spark: SparkSession, path: str, flush_ops: int = 10_000, sync_every: float | None = None):
        self.spark, self.path, self.flush_ops, self.sync_every = spark, path.rstrip("/"), flush_ops, sync_every
        self.pending: list[tuple[str, bool, str]] = []
        self.synced = time.monotonic()

    def _claim(self) -> int:
        """The number of a run of one's own, above all that are there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims")
        fs = folder.getFileSystem(conf)
        fs.mkdirs(folder)
        taken = [int(s.getPath().getName()) for s in fs.listStatus(folder)]
        last = self._committed().agg(F.max("seg")).first()[0]
        seg = max([*taken, -1 if last is None else last]) + 1
        while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{seg}")):
            seg += 1
        return seg

    def _numbered(self, seg: int) -> DataFrame:
        """What has been put but not committed, as rows of a run."""
        return self.spark.createDataFrame([(k, (seg << 32) + i, seg, d, v) for i, (k, d, v) in enumerate(self.pending)], KV_LOG)

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and any(s.getPath().getName().startswith("seg=") for s in fs.listStatus(p))

    def _committed(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], KV_LOG)
        return self.spark.read.schema(KV_LOG).parquet(self.path).select(*KV_LOG.names)

    def log(self) -> DataFrame:
        """Every row, those not committed yet among them."""
        kept = self._committed()
        return kept.unionByName(self._numbered((1 << 31) - 1)) if self.pending else kept

    def _add(self, key: str, deleted: bool, value: str) -> None:
        access.check_pair(key, value)
        self.pending.append((key, deleted, value))
        late = self.sync_every is not None and time.monotonic() - self.synced >= self.sync_every
        if late or len(self.pending) >= self.flush_ops:
            self.sync()

    def put(self, key: str, value: str) -> None:
        self._add(key, False, value)

    def put_all(self, pairs: DataFrame) -> None:
        """Commit a DataFrame (key, value) as one run; rows with the same key: the greater value stays."""
        self.sync()
        one = access.checked(pairs.groupBy("key").agg(F.max("value").alias("value")))
        seg = self._claim()
        rows = one.select("key", F.lit(seg << 32).alias("seq"), F.lit(seg).cast("long").alias("seg"), F.lit(False).alias("deleted"), "value")
        rows.write.mode("append").partitionBy("seg").parquet(self.path)

    def delete(self, key: str, strict: bool = False) -> None:
        if strict and self.get(key) is None:
            raise MissingKey(key)
        self._add(key, True, "")

    def get(self, key: str, strict: bool = False) -> str | None:
        return access.get_value(self.log(), key, strict)

    def list_keys(self) -> list[str]:
        return [r[0] for r in access.list_keys(self.log()).toLocalIterator()]

    def fold(self, f: Callable, acc):
        """f(key, value, acc) over the live pairs in key order, one after another on the driver."""
        for r in live(self.log()).select("key", "value").orderBy("key").toLocalIterator():
            acc = f(r[0], r[1], acc)
        return acc

    def sync(self) -> None:
        """Commit what has been put as one sorted run."""
        if not self.pending:
            return
        out = runs.flushed(self._numbered(self._claim())).coalesce(1).sortWithinPartitions("key")
        out.write.mode("append").partitionBy("seg").option("parquet.bloom.filter.enabled#key", "true").parquet(self.path)
        self.pending, self.synced = [], time.monotonic()

    close = sync

    def merge(self) -> None:
        """Rewrite all runs but the newest to their live rows.

        The kept rows are committed as a run of their own before any old run goes. Versions are ordered by
        seq, never by run, so rows that are there twice change nothing. Old runs go oldest first: a
        tombstone never goes before what it hides, so a merge that stops half way loses and revives nothing.
        """
        self.sync()
        log = self._committed()
        names = sorted(r[0] for r in log.select("seg").distinct().collect())  # one row a run
        if len(names) < 2:
            return
        keep = compact.merged(log).withColumn("seg", F.lit(self._claim()).cast("long"))
        keep.sortWithinPartitions("key").write.mode("append").partitionBy("seg").parquet(self.path)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.path).getFileSystem(conf)
        for seg in names[:-1]:
            fs.delete(path(f"{self.path}/seg={seg}"), True)
