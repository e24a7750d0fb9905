"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Two fingerprints with at most `bits` differing
bits differ by at most t_i bits in at least one segment i, whenever the sum of (t_i + 1) is
above `bits`. So each fingerprint probes, in segment i, the values in the Hamming ball of
radius t_i around its own, meets every fingerprint filed under such a value, and the whole
distance is verified. How many segments there are follows from the number of fingerprints: many
short ones have small balls, few long ones have small buckets (`segments_for`).

Copies are one fingerprint. A bucket that very many different fingerprints share is first tied
to two pivots (one row a member, not all pairs); a probe then only meets members of a bucket
that are not in its group yet. No link between different fingerprints is lost: a pair is
skipped only if it is connected already.

Defined results: a null text is an empty one; no words gives fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; ties and repeated rows keep a row each; a
null doc_id is never a component's id (a component of null ids alone has a null id); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.llm.common import small_batches, written
from cairnlog.llm.graph import components

WORDS = 4  # of a shingle
BITS = 4  # that may differ
SEED = 42
LEAST_BITS = 20  # of a segment


def segments_for(n: int, bits: int = BITS) -> tuple[tuple[int, int, int], ...]:
    """(first bit, bits, radius) of the segments with least work for n fingerprints spread evenly.

    Work is lookups and candidates: balls times what a bucket holds. The radii plus one add up to bits + 1.
    Fingerprints of texts crowd in short segments, so none is below LEAST_BITS.
    """
    best = None
    for k in range(1, min(bits + 1, 64 // LEAST_BITS) + 1):
        edges = [64 * i // k for i in range(k + 1)]
        radii = [(bits + k - i) // k - 1 for i in range(k)]
        found = tuple((a, b - a, t) for a, b, t in zip(edges, edges[1:], radii))
        work = sum(sum(comb(w, r) for r in range(t + 1)) * (1 + n / 2**w) for _, w, t in found)
        if best is None or work < best[0]:
            best = (work, found)
    return best[1]


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every `words`-word shingle (all words if fewer, none if no words), repeats included, as uint64."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((h(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned number: a bit is 1 if it is set in over half of the hashes."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[i : i + (1 << 14)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed number."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _filed(fps: DataFrame, segments) -> DataFrame:
    """A row for each fingerprint and segment, under the segment's value."""
    values = [F.shiftrightunsigned("fp", i).bitwiseAND(F.lit((1 << w) - 1)) for i, w, _ in segments]
    return fps.select("*", F.posexplode(F.array(*values)).alias("seg", "val"))


def _probes(fps: DataFrame, segments) -> DataFrame:
    """A row for each fingerprint, segment and mask of the segment's ball that it has to look up.

    Of two values that differ by a mask, one has the mask's lowest bit clear; that one looks.
    """
    balls = [
        f"named_struct('seg', {k}, 'first', {i}, 'all', {(1 << w) - 1}L, 'mask', {m}L, 'low', {m & -m}L)"
        for k, (i, w, t) in enumerate(segments)
        for r in range(t + 1)
        for m in (sum(1 << x for x in c) for c in combinations(range(w), r))
    ]
    looks = F.filter(
        F.expr(f"array({', '.join(balls)})"),
        lambda s: F.call_function("shiftrightunsigned", F.col("fp"), s["first"]).bitwiseAND(s["low"]) == 0,
    )
    value = F.call_function("shiftrightunsigned", F.col("fp"), F.col("s.first")).bitwiseAND(F.col("s.all"))
    return fps.select("*", F.explode(looks).alias("s")).select(
        *fps.columns, F.col("s.seg").alias("seg"), value.bitwiseXOR(F.col("s.mask")).alias("val")
    )


def links(fps: DataFrame, bits: int = BITS, segments=None) -> DataFrame:
    """(fp, root): the group of every fingerprint of fps (fp long, n long), which has each of them once."""
    segments = segments or segments_for(fps.count(), bits)
    if sum(t + 1 for _, _, t in segments) <= bits:
        raise ValueError("the segments' radii are too small for this distance")
    filed = _filed(fps.select("fp", "n"), segments)
    pivots = (
        filed.groupBy("seg", "val")
        .agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("n", "fp"))["fp"].alias("p"), F.min("fp").alias("q"))
        .where("m > 1")
        .select("seg", "val", "p", "q")
    )
    stars = (
        filed.join(pivots, ["seg", "val"])
        .select("fp", F.explode(F.array("p", "q")).alias("to"))
        .where((F.col("fp") != F.col("to")) & (_differ("fp", "to") <= bits))
        .select(F.col("fp").alias("a"), F.col("to").alias("b"))
    )
    tied = components(stars).withColumnRenamed("node", "fp")
    now = written(fps.select("fp").join(tied, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "tied")

    filed = _filed(now, segments)
    buckets = filed.groupBy("seg", "val").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_probes = (
        _probes(now, segments)
        .join(buckets, ["seg", "val"])
        .where("root <> lo OR root <> hi")
        .select("seg", "val", F.col("fp").alias("by"), F.col("root").alias("by_root"))
    )
    crossing = (
        open_probes.join(filed, ["seg", "val"])
        .where((F.col("root") != F.col("by_root")) & (_differ("fp", "by") <= bits))
        .select(F.col("root").alias("a"), F.col("by_root").alias("b"))
    )
    merged = components(crossing).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return now.join(merged, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, segments=None) -> DataFrame:
    """(doc_id, fp long, component_id): the component's smallest doc_id, for every row of docs (doc_id, text)."""
    prints = written(fingerprints(docs, words), "prints")
    fps = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "fps")
    groups = fps.join(links(fps, bits, segments), "fp").select("fp", "least", "root")
    heads = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(groups.join(heads, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS, segments=None) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, that stay: one row of each group.

    It is that with the smallest doc_id, null ids last; of rows with the same id that with the least hash of
    its text, then the first in the table. Groups of null ids each keep a row, and so do groups that share an id.
    """
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_n"), F.col("doc_id").alias("_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = written(rows.select("_row", "_n", "_id", F.xxhash64("text").alias("_h")), "rows")
    text = F.col("_row").getField("text").cast("string")
    prints = written(fingerprints(rows.select(F.struct("_n", "_id", "_h").alias("doc_id"), text.alias("text")), words), "prints")
    first = F.min(F.struct(F.col("doc_id._id").isNull().alias("none"), F.col("doc_id._id").alias("id"), F.col("doc_id._h").alias("h"), F.col("doc_id._n").alias("n")))
    fps = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("first")), "fps")
    groups = fps.join(links(fps.select("fp", "n"), bits, segments), "fp")
    heads = groups.groupBy("root").agg(F.min("first")["n"].alias("_n"))
    kept = rows.join(heads.select("_n"), "_n", "left_semi")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
