"""Bottom-k sketches of word shingles as document fingerprints.

A sketch holds the k smallest distinct hashes of a text's five-word shingles (all of them if
there are fewer). Sketches of parts merge into that of the whole; two sketches estimate the
texts' resemblance and containment, and one estimates the number of distinct shingles.

`edited` compares each document with an edited text whose second half is the beginning of the
next document by id. Rows are ordered by id (of any type that has an order), then by a hash of the text,
then by their place in the table, so no two are equal and rows of one id can be in several ranges. They are
dealt to ranges once; the first row of a range is also sent to the range before, where it follows the
last row, so no task sees all rows and no join is needed.

Defined results: a null text is an empty one; a text without words has an empty sketch, and two
empty sketches resemble each other fully, an empty and another not at all; rows with the same id
are ordered by a hash of their text; rows with a null id come first; an only document is its own next; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.llm.common import small_batches
from cairnlog.llm.simhash import shingle_hashes

WORDS = 5
K = 128


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    h = shingle_hashes(text, words)
    if len(h) > 4 * k:  # only the smallest can count; repeats may call for more of them
        small = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(small) >= k:
            return small[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; exact if neither sketch is full."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= union[-1]).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    top = min((s[-1] for s in (a, b) if len(s) >= k), default=a[-1])
    own = a[a <= top]
    return float(np.isin(own, b, assume_unique=True).sum() / len(own)) if len(own) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact if the sketch isn't full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def packed(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, big-endian, ascending."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


#: Rows that the ranges' bounds are taken from, for each range; a bottom sample by a hash of the order.
SAMPLED = 64


def _ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _p, _late): rows dealt to ranges _p of their order and sorted; _late marks the row after a range's last."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select("doc_id", "text", order.alias("_o"))
    some = rows.select("_o").orderBy(F.xxhash64("_o")).limit(SAMPLED * n)  # a bounded sample
    ranked = some.select("_o", F.row_number().over(Window.orderBy("_o")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    bound = F.col("i") % F.greatest(F.lit(1), F.floor(F.col("m") / n))
    cuts = [r[0] for r in ranked.where((bound == 0) & (F.col("i") > 1)).orderBy("_o").limit(n - 1).select("_o").collect()] if n > 1 else []
    kind = rows.schema["_o"].dataType
    literal = lambda r: F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields))
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda array: F.size(F.filter(array, lambda c: c <= F.col("_o")))
    if groups:
        # two short searches: among the groups' first cuts, then inside the group
        g = below(F.array(*[literal(x[0]) for x in groups]))
        inner = F.array(*[F.array(*map(literal, x)) for x in groups])
        p = F.when(g == 0, F.lit(0)).otherwise((g - 1) * wide + below(F.get(inner, g - 1)))
    else:
        p = F.lit(0)
    rows = rows.withColumn("_p", p.cast("int"))
    first = rows.groupBy("_p").agg(F.min("_o").alias("m")).orderBy("_p").collect()  # a row for each range
    before = [(r[0], r[1], first[i - 1][0]) for i, r in enumerate(first)]
    before = spark.createDataFrame(before, T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("_m", kind), T.StructField("_before", T.IntegerType())]))
    here = F.struct(F.col("_p").alias("p"), F.lit(False).alias("late"))
    back = F.struct(F.col("_before").alias("p"), F.lit(True).alias("late"))
    return (
        rows.join(F.broadcast(before), F.col("_p") == F.col("_q"))
        .withColumn("_to", F.explode(F.when(F.col("_o") == F.col("_m"), F.array(here, back)).otherwise(F.array(here))))
        .select("doc_id", "text", "_o", F.col("_to.p").alias("_p"), F.col("_to.late").alias("_late"))
        .repartitionById(n, F.col("_p"))
        .sortWithinPartitions("_p", "_late", "_o")
        .drop("_o")
    )


def edited(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness to each other and to the next row's."""
    small_batches(docs.sparkSession)
    rows = _ranges(docs)

    def finish(row, after) -> tuple:
        doc_id, text, own = row
        half = len(text) // 2
        new = text[: len(text) - half] + after[1][:half]
        if new == text:
            changed = own
        else:
            changed = sketch(new, k, words)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            doc_id, len(text), sha, packed(own), packed(changed), resemblance(own, changed, k),
            resemblance(own, after[2], k), distinct(own, k), containment(own, changed, k),
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, distinct_shingles double, kept_share double"
    )
    names = [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        "distinct_shingles", "kept_share",
    ]

    def run(batches):
        held, at = None, None  # the row that waits for its next, and its range
        for b in batches:
            out, id_type = [], b.schema.field("doc_id").type
            for doc_id, text, p, late in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_p", "_late"))):
                row = (doc_id, text, sketch(text, k, words))
                if held is not None:
                    out.append(finish(held, row))
                held, at = (None, None) if late else (row, p)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *map(pa.array, cols[1:])], names)
        assert held is None, "a range ends without the row after it"

    return rows.mapInArrow(run, schema)
