"""What the operators of this subpackage share: scratch tables, batch sizes, labelled samples."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that one Arrow batch may hold; long texts make larger rows, so this stays small.
BATCH_ROWS = 256


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: the shared one named by spark.checkpoint.dir.

    Where that is unset, a temporary folder serves, but on a local master only: executors of
    a cluster could not see it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="cairnlog-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cairnlog-{sc.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once, as a Parquet table in the scratch folder: lost executors recompute nothing."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame | None) -> None:
    """Delete the files of a table that `written` made and that no result depends on."""
    if df is None:
        return
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if f"cairnlog-{spark.sparkContext.applicationId}" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables, once its results have been read or written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of Arrow batches of whole texts, unless the session already has a smaller bound.

    Spark's own bound on a batch's bytes holds beside it. The setting stays, as plans run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def gathered_batches(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Successive batches as one, as long as `column` has no more than about `size` bytes in them together."""
    held, have = [], 0
    for b in batches:
        n = b.column(column).nbytes
        if held and have + n > size:
            yield pa.concat_batches(held)
            held, have = [], 0
        held.append(b)
        have += n
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 5, is 0 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, total_bytes: int) -> list[tuple[str, int]]:
    """At most `rows` labelled whole texts of the training fold, as (text, label), for fitting on the driver.

    The labels are sampled first, by a hash of their id, and only the sample is broadcast to the
    scan of the texts. Any length counts: in the order of the hash, texts are taken until those before
    have `total_bytes` bytes, which bounds the driver's memory whatever the texts' lengths. Ids labelled
    twice count once, with the larger label; of the texts of a repeated id, that with the least hash.
    """
    order = F.xxhash64("doc_id", F.lit(7))
    train = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    sample = train.orderBy(order, "doc_id").limit(rows)
    text = F.col("text").cast("string")
    found = (
        docs.select("doc_id", text.alias("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(sample), "doc_id")  # at most `rows` rows
        .groupBy("doc_id", "_label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_own"))
        .select("doc_id", "_label", order.alias("_order"), F.col("_own.text").alias("text"))
    )
    kept = written(found, "sample")
    sizes = kept.select("_order", "doc_id", F.octet_length("text")).orderBy("_order", "doc_id").collect()  # at most `rows` numbers
    taken, last = 0, None
    for r in sizes:
        if taken >= total_bytes:
            break
        taken, last = taken + r[2], r
    if last is None:
        return []
    own = kept.select("_order", "doc_id", "text", "_label").where(
        (F.col("_order") < last[0]) | ((F.col("_order") == last[0]) & (F.col("doc_id") <= last[1]))
    )
    got = [(r[2], int(r[3])) for r in sorted(own.collect(), key=lambda r: (r[0], r[1]))]  # total_bytes and one text at most
    forget(kept)
    return got
