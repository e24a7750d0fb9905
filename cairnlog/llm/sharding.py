"""Weighted rendezvous hashing of stable record keys onto shards.

Every shard draws a score for a key from a hash of (key, shard); the key goes to the shard
with the best score. The scores of the shards that were there before do not change when a
shard is added, so the new shard takes its share of keys and no key moves between old ones.

Within a shard rows get gapless slots without sorting a shard in one task: rows are dealt to
(shard, block) cells by a hash of the key, ranked inside their cell, and shifted by the number
of rows in the shard's earlier cells. The table of cell sizes has at most shards * blocks rows; the
blocks grow with the table, and beyond the least number of them it is joined without a hint. A cell that
rows of one key make far larger than the mean is split by the rows themselves, written with numbers first.

Defined results: a null key is a key of its own; a null text has no bytes (size 1, checksum of
the empty text); repeated rows each get a slot; an empty table gives an empty result; columns
other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.llm.common import written

#: Cells that the rows of one shard are dealt to for ranking, at least, and mean rows of a cell beyond which there are more.
BLOCKS, BLOCK_ROWS = 512, 100_000
#: How many times the mean rows of a cell make one to be split.
HOT = 10


def _number(text: Column, digits: int) -> Column:
    """The first hex digits of a text's MD5 as a number. Any engine can compute it, so shards can be found without Spark."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) of a key: argmax over shards of -weight / ln(u), u a hash in (0, 1) of (key, shard)."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        # 52 bits of the hash, moved off 0 and 1
        u = (_number(F.concat(text, F.lit(f"/{shard}")), 13).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("s"), F.lit(-shard).alias("n"))

    best = [score(i, w) for i, w in enumerate(weights)]
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["n"]).cast("int")


def slots(rows: DataFrame, shard: str, key: Column, ties: list[str], blocks: int = BLOCKS) -> DataFrame:
    """`rows` with a column `slot`, gapless from 0 within each value of `shard`; rows of one key are told apart by `ties`."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    dealt = rows.withColumns({"_block": (_number(F.concat(text, F.lit("/slot")), 8) % blocks).cast("int"), "_part": F.lit(0).cast("long")})
    cells = written(dealt.groupBy(shard, "_block", "_part").agg(F.count(F.lit(1)).alias("_n")), "cells")
    few = F.broadcast if blocks <= BLOCKS else (lambda t: t)  # at most shards * blocks rows
    large = cells.where(F.col("_n") > HOT * BLOCK_ROWS)
    if not large.isEmpty():
        dealt = written(dealt.drop("_part").withColumn("_row", F.monotonically_increasing_id()), "slots")
        parts = large.select(shard, "_block", F.ceil(F.col("_n") / F.lit(BLOCK_ROWS)).alias("_parts"))
        part = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0)).cast("long")
        dealt = dealt.join(few(parts), [shard, "_block"], "left").withColumn("_part", part).drop("_row", "_parts")
        cells = dealt.groupBy(shard, "_block", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block", "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(shard, "_block", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(shard, "_block", "_part").orderBy(key, *ties)) - 1
    return (
        dealt.withColumn("_rank", rank)
        .join(few(cells), [shard, "_block", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_block", "_part", "_rank", "_before")
    )


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, blocks: int | None = None) -> DataFrame:
    """Law `key`: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard with one more of `grown_weight`)."""
    if blocks is None:  # the table is counted, which reads no column
        blocks = max(BLOCKS, -(-docs.select().count() // (len(weights) * BLOCK_ROWS)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    return slots(rows, "shard", F.col("doc_id"), ["size", "text_crc32"], blocks).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
