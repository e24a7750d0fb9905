"""Streams of log rows: the newest version of each key as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairnlog.model import KV_LOG
from cairnlog.operators.resolve import latest


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet log files as a stream."""
    return spark.readStream.schema(KV_LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def compacted(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch, resolved to one row a key, as a run under `out`; the batch's number names the run.

    A batch that is repeated after a failure overwrites its own run, so every row counts once.
    """

    def run(batch: DataFrame, number: int) -> None:
        latest(batch).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{out}/run={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_compacted(spark: SparkSession, out: str) -> DataFrame:
    """What `compacted` has written, resolved across its runs."""
    return latest(spark.read.schema(KV_LOG).option("recursiveFileLookup", "true").parquet(out))
