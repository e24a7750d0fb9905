"""Reads and writes of the key-value log as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.model import KEY_MAX, VALUE_MAX, MissingKey, SizeLimit
from cairnlog.operators.resolve import latest, live


def get(log: DataFrame, key: str, dialect: str = "flag") -> DataFrame:
    """The live row of one key, or none. The key's filter reaches the scan."""
    return live(log.where(F.col("key") == key), dialect)


def get_value(log: DataFrame, key: str, strict: bool = False, dialect: str = "flag"):
    """The value of one key; None, or an error if strict, where it is not live."""
    row = get(log, key, dialect).select("value").first()
    if row is None:
        if strict:
            raise MissingKey(key)
        return None
    return row[0]


def multi_get(log: DataFrame, probes: DataFrame, dialect: str = "flag") -> DataFrame:
    """key, found and value of every probe (key). Only rows of probed keys are resolved."""
    probes = probes.select("key").distinct()
    got = live(log.join(probes, "key", "left_semi"), dialect).select("key", "value", F.lit(True).alias("_hit"))
    return probes.join(got, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("found"), "value")


def contains(log: DataFrame, probes: DataFrame, dialect: str = "flag") -> DataFrame:
    return multi_get(log, probes, dialect).select("key", "found")


def list_keys(log: DataFrame, dialect: str = "flag") -> DataFrame:
    """All live keys, in no order. With the flag dialect values are not read."""
    return live(log, dialect).select("key")


def fold(log: DataFrame, *aggregates: Column, dialect: str = "flag") -> DataFrame:
    """Aggregates over live pairs whose order does not matter."""
    return live(log, dialect).agg(*aggregates)


def fold_ordered(log: DataFrame, start, step: Callable[[Column, Column, Column], Column], dialect: str = "flag") -> DataFrame:
    """One row `acc`: step(acc, key, value) over the live pairs in key order.

    A fold that need not be associative is sequential by definition: all live pairs go to one task.
    Use `fold` or `fold_chunks` wherever the fold allows.
    """
    pairs = live(log, dialect).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("p"))
    acc = F.lit(start) if not isinstance(start, Column) else start
    return pairs.select(F.reduce("p", acc, lambda a, p: step(a, p["key"], p["value"])).alias("acc"))


def fold_chunks(log: DataFrame, piece: Column, separator: str, partitions: int, dialect: str = "flag") -> DataFrame:
    """(chunk, text): the pieces of live pairs joined in key order, in as many range chunks as asked for.

    Joining the chunks in order gives the fold; each task holds one chunk only.
    """
    rows = live(log, dialect).withColumn("piece", piece).repartitionByRange(partitions, "key").sortWithinPartitions("key")
    rows = rows.select(F.spark_partition_id().alias("chunk"), "key", "piece")
    return rows.groupBy("chunk").agg(F.expr(f"listagg(piece, '{separator}') WITHIN GROUP (ORDER BY key)").alias("text"))


def checked(rows: DataFrame) -> DataFrame:
    """rows, failing where a key or a value is above the limits."""
    bad = (F.octet_length("key") > KEY_MAX) | (F.coalesce(F.octet_length("value"), F.lit(0)) > VALUE_MAX)
    message = F.format_string("key of %d or value of %d bytes is above the limit", F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)))
    return rows.withColumn("key", F.when(bad, F.raise_error(message)).otherwise(F.col("key")))


def check_pair(key: str, value: str | None) -> None:
    if len(key.encode()) > KEY_MAX or len((value or "").encode()) > VALUE_MAX:
        raise SizeLimit(f"key of {len(key.encode())} or value of {len((value or '').encode())} bytes is above the limit")


def put(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """The log with puts (key, seq, seg, value) appended."""
    return log.unionByName(checked(pairs).withColumn("deleted", F.lit(False)).select(*log.columns))


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with tombstones (key, seq, seg) appended, whether the keys are live or not."""
    return log.unionByName(keys.withColumns({"deleted": F.lit(True), "value": F.lit("")}).select(*log.columns))


def delete_strict(log: DataFrame, keys: DataFrame, dialect: str = "flag") -> tuple[DataFrame, DataFrame]:
    """The log with tombstones of live keys only, and the keys that were refused."""
    alive = list_keys(log, dialect)
    return delete(log, keys.join(alive, "key", "left_semi")), keys.join(alive, "key", "left_anti")


def rejected_deletes(log: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Deletes in the log whose key was not live just before: its first row, or one after another delete.

    Rows are looked at within spans of seq, and only each span's last state of a key goes on to the next, so the
    rows of a hot key are many tasks' work.
    """
    rows = log.withColumn("_span", F.floor(F.col("seq") / span).cast("long"))
    before = F.lag("deleted").over(Window.partitionBy("key", "_span").orderBy("seq"))
    last = rows.groupBy("key", "_span").agg(F.max_by("deleted", "seq").alias("_last"))
    carried = last.select("key", "_span", F.lag("_last").over(Window.partitionBy("key").orderBy("_span")).alias("_carried"))
    seen = rows.withColumn("_was", before).where("deleted").join(carried.withColumnsRenamed({"key": "_key", "_span": "_at"}), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at")))
    return seen.where(F.coalesce("_was", "_carried", F.lit(True))).select(*log.columns)


def overwrite(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base with the newer rows of delta, newest first by seq."""
    return latest(base.unionByName(delta))


def keys_frame(log: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A short list of keys as a DataFrame."""
    return log.sparkSession.sql("SELECT explode(:keys) AS key", args={"keys": list(keys)})
