"""Bloom filters as one row a run with an array of 64-bit words: 10 bits a key and 7 hashes by default, no false negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.model import BLOOM_BITS_PER_KEY, BLOOM_HASHES


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(key: Column, bits: Column, hashes: int = BLOOM_HASHES) -> Column:
    """The bits of a key: h1 + i * h2 modulo the filter's size, from the halves of the key's MD5, which any engine has."""
    half = lambda digest, at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")

    def both(digest: Column) -> Column:
        return F.struct((half(digest, 1) % bits).alias("a"), (half(digest, 17) % (bits - 1) + 1).alias("b"))

    return _let(_let(F.md5(key.cast("binary")), both), lambda h: F.array(*[(h["a"] + i * h["b"]) % bits for i in range(hashes)]))


def filter_bits(n: Column, per_key: int = BLOOM_BITS_PER_KEY) -> Column:
    """Bits of a filter for n keys, 64 at least, so that a filter of few or only deleted keys still works."""
    return F.greatest(n * per_key, F.lit(64)).cast("long")


def build(keys: DataFrame, run: str = "seg", key: str = "key") -> DataFrame:
    """(run, bits, word, mask) of the filter of each run; a word without a bit has no row.

    keys has each (run, key) once or more. Words are merged in the map stage, so little is shuffled.
    """
    sizes = keys.groupBy(run).agg(filter_bits(F.count_distinct(key)).alias("bits"))
    set_bits = keys.join(sizes, run).select(run, "bits", F.explode(positions(F.col(key), F.col("bits"))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    return set_bits.groupBy(run, "bits", F.shiftright("p", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def packed(words: DataFrame, run: str = "seg") -> DataFrame:
    """(run, bits, words): one row a run with all its words in order, those without a bit too."""
    last = F.floor((F.col("bits") - 1) / 64).cast("long")
    none = words.select(run, "bits").distinct().select(run, "bits", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("word"), F.lit(0).cast("long").alias("mask"))
    every = words.unionByName(none).groupBy(run, "bits", "word").agg(F.bit_or("mask").alias("mask"))
    rows = every.groupBy(run, "bits").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return rows.select(run, "bits", F.col("w.mask").alias("words"))


def probe(filters: DataFrame, probes: DataFrame, run: str = "seg", key: str = "key") -> DataFrame:
    """(run, key, maybe) for every row of probes (run, key), by the filters of `packed`: False is certain."""

    def is_set(p: Column) -> Column:
        word = F.get(F.col("words"), F.shiftright(p, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return probes.select(run, key).join(filters, run).select(run, key, F.forall(positions(F.col(key), F.col("bits")), is_set).alias("maybe"))
