"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent and normalised. Exponent 1
keeps the shares, smaller ones flatten them. The exponent is bisected until the weights have a
target entropy, or until no source is repeated more often than a limit; the larger one, which
flattens less, holds if both are given. Bisection steps are taken five at a time: one distributed
aggregate evaluates all 31 exponents that the next five steps can ask for, so only sums reach
the driver, however many sources there are.

The weights are realised with a token budget. Sources are dealt to blocks of about BLOCK_ROWS
documents by a hash, so a hot source is many blocks and no task orders a whole source. A block
has its share of the source's budget. It is gone through in a permutation, a new one each epoch,
for as many whole epochs as the budget pays, and then up to the document that first reaches the
rest. With the default budget the source that is repeated least is read exactly once, so every
document is kept and the others are repeated.

Defined results: a null source is a source of its own; a null or empty text counts one token;
repeated rows and rows with a null id count each; an empty table gives an empty result; other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.llm.common import written

#: Mean documents of a block, how many times that makes a block one to be split, and how many blocks `mixed` has at most, about.
BLOCK_ROWS, HOT, BLOCKS = 64, 16, 1 << 16
#: Small tables are broadcast up to this many rows, counted first.
BROADCAST_ROWS = 200_000
LEVELS = 5
MAX_REPEATS = 2.0


def tokens(text: Column) -> Column:
    """White-space tokens of a text, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))).cast("long")


def exponent(sizes: DataFrame, entropy: float | None, repeats: float | None, rounds: int = 6) -> float:
    """The largest exponent of 0 to 1 with at least `entropy` (nats), or the smallest that keeps to `repeats`.

    sizes: _mix_tokens, a row for each source. If both are given the larger exponent holds. Where
    even exponent 0 has too little entropy, 0 is the answer; with neither target it is 1.
    """
    total = sizes.agg(F.sum("_mix_tokens"), F.min("_mix_tokens"), F.max("_mix_tokens")).first()
    if not total[0]:
        return 1.0
    share = F.col("_mix_tokens") / F.lit(float(total[0]))
    answers = []
    if repeats is not None:
        # weight / share, relative to the source read once: (largest / smallest) ** (1 - exponent)
        spread = math.log(total[2] / total[1])
        lo, hi = 0.0, 1.0
        for _ in range(rounds * LEVELS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if spread * (1 - mid) <= math.log(max(1.0, repeats)) else (mid, hi)
        answers.append(hi)
    if entropy is not None:
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            step = (hi - lo) / 2**LEVELS
            tried = [lo + step * i for i in range(1, 2**LEVELS)]
            power = [F.pow(share, F.lit(a)) for a in tried]
            sums = sizes.agg(*(F.sum(p) for p in power), *(F.sum(p * F.ln(p)) for p in power)).first()
            found = {i + 1: math.log(z) - y / z for i, (z, y) in enumerate(zip(sums[: len(tried)], sums[len(tried) :]))}
            a, b = 0, 2**LEVELS
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if found[mid] >= entropy else (a, mid)
            lo, hi = lo + step * a, lo + step * b
        answers.append(lo)
    return max(answers, default=1.0)


def weights(sizes: DataFrame, alpha: float) -> DataFrame:
    """sizes with _mix_weight, which add up to 1."""
    total = sizes.agg(F.sum(F.pow(F.col("_mix_tokens").cast("double"), F.lit(alpha)))).first()[0] or 1.0
    return sizes.withColumn("_mix_weight", F.pow(F.col("_mix_tokens").cast("double"), F.lit(alpha)) / F.lit(total))


def plan(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: float | None = None,
    seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A row for each time that a row of docs (doc_id, text, source) is read.

    doc_id, source, tokens, epoch, block, position (in the block's part and epoch), weight and alpha;
    mix_order is the fraction of its block's budget that came before, and sorting by it interleaves
    sources by weight. budget: tokens in all; by default the least that reads all sources once.
    """
    rows = docs.select("doc_id", "source", tokens(F.col("text")).alias("_mix_n"), F.monotonically_increasing_id().alias("_mix_row"))
    rows = written(rows, "mix")
    shares, alpha = _shares(rows, entropy, repeats, budget, block_rows)
    dealt = _dealt(rows, shares, seed, block_rows)
    read = _read(dealt, seed, F.sequence(F.lit(0), F.greatest(F.ceil("_mix_reads") - 1, F.lit(0)).cast("int")), ["doc_id", "_mix_n"])
    return read.select(
        "doc_id", "source", F.col("_mix_n").alias("tokens"), F.col("_mix_epoch").alias("epoch"),
        F.col("_mix_block").alias("block"), F.col("_mix_position").cast("long").alias("position"),
        ((F.col("_mix_epoch") + F.col("_mix_before") / F.col("_mix_of")) / F.col("_mix_reads")).alias("mix_order"),
        F.col("_mix_weight").alias("weight"), F.lit(alpha).alias("alpha"),
    )


def _shares(rows: DataFrame, entropy, repeats, budget, block_rows) -> tuple[DataFrame, float]:
    """_mix_source, _mix_weight, _mix_reads (of each of its tokens) and _mix_blocks of every source; and the exponent."""
    sizes = written(rows.groupBy("source").agg(F.sum("_mix_n").alias("_mix_tokens"), F.count(F.lit(1)).alias("_mix_rows")), "sizes")
    alpha = exponent(sizes, entropy, repeats)
    shares = weights(sizes, alpha)
    if budget is None:
        budget = shares.agg(F.max(F.col("_mix_tokens") / F.col("_mix_weight"))).first()[0] or 0.0
    # reads of a source's tokens; a hair's breadth below a whole number is that number
    reads = F.round(F.col("_mix_weight") * F.lit(float(budget)) / F.col("_mix_tokens"), 9)
    return shares.select(
        F.col("source").alias("_mix_source"), "_mix_weight", reads.alias("_mix_reads"), F.ceil(F.col("_mix_rows") / F.lit(block_rows)).alias("_mix_blocks")
    ), alpha


def _few(table: DataFrame) -> DataFrame:
    """A table with a broadcast hint, if counting shows that it is small; else as it is."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _number(text: Column, digits: int) -> Column:
    """The first hex digits of a text's MD5 as a number: any engine can compute it."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _name() -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col("doc_id").cast("string")), F.lit("null"))


def _dealt(rows: DataFrame, shares: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """rows with their source's share, _mix_block by a hash of the id, and _mix_part.

    Rows of one id, or of none, are one block however many there are; blocks far above the mean
    are dealt to parts by the rows themselves.
    """
    block = _number(F.concat(_name(), F.lit(f"/block/{seed}")), 8) % F.col("_mix_blocks")
    dealt = rows.join(_few(shares), F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source").withColumn("_mix_block", block.cast("long"))
    hot = dealt.groupBy("source", "_mix_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT * block_rows)
    hot = written(hot.select(F.col("source").alias("_mix_from"), F.col("_mix_block").alias("_mix_at"), F.ceil(F.col("n") / F.lit(block_rows)).alias("_mix_parts")), "hot")
    if hot.isEmpty():
        return dealt.withColumn("_mix_part", F.lit(0).cast("long"))
    same = F.col("source").eqNullSafe(F.col("_mix_from")) & (F.col("_mix_block") == F.col("_mix_at"))
    part = F.coalesce(F.pmod(F.xxhash64("_mix_row", F.lit(seed)), F.col("_mix_parts")), F.lit(0)).cast("long")
    return dealt.join(_few(hot), same, "left").withColumn("_mix_part", part).drop("_mix_from", "_mix_at", "_mix_parts")


def _key(epoch: Column, seed: int) -> Column:
    """What orders the rows of a block in an epoch."""
    return _number(F.concat(_name(), F.lit("/"), epoch.cast("string"), F.lit(f"/{seed}")), 15)


def _read(dealt: DataFrame, seed: int, epochs: Column, ties: list[str]) -> DataFrame:
    """A row for each of the epochs in which a row's block reaches it, with what comes before it there."""
    read = dealt.withColumn("_mix_epoch", F.explode(epochs)).withColumn("_mix_key", _key(F.col("_mix_epoch"), seed))
    block = Window.partitionBy("source", "_mix_block", "_mix_part", "_mix_epoch")
    order = block.orderBy("_mix_key", *ties, "_mix_row")
    before = F.coalesce(F.sum("_mix_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = F.col("_mix_of") * (F.col("_mix_reads") - F.col("_mix_epoch"))
    return (
        read.withColumn("_mix_of", F.sum("_mix_n").over(block))
        .withColumn("_mix_before", before)
        .withColumn("_mix_position", F.row_number().over(order) - 1)
        .where((F.col("_mix_before") < due) | (F.col("_mix_reads") >= F.col("_mix_epoch") + 1))
    )


def mixed(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 42,
) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, each as often as the mix reads it.

    Every row counts for itself, those with a null id or an id that is there before too. Texts are not
    shuffled: how often a whole source is read, and the last row that each block reads in its last epoch,
    are small tables that the scan of the rows is joined with. Blocks grow with the table, so that these stay small.
    """
    own = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"), "doc_id", "source", tokens(F.col("text")).alias("_mix_n"),
        F.monotonically_increasing_id().alias("_mix_row"),
    )
    own = written(own, "mixing")
    narrow = own.drop("_row")
    block_rows = max(BLOCK_ROWS, -(-own.select().count() // BLOCKS))
    shares, _ = _shares(narrow, entropy, repeats, budget, block_rows)
    last = F.floor("_mix_reads").cast("int")
    partly = _dealt(narrow, shares, seed, block_rows).where(F.col("_mix_reads") > last)
    read = _read(partly, seed, F.array(last), [])
    ends = read.groupBy("source", "_mix_block", "_mix_part").agg(F.max(F.struct("_mix_key", "_mix_row")).alias("_mix_end"))
    ends = written(ends.select(F.col("source").alias("_mix_from"), F.col("_mix_block").alias("_mix_at"), F.col("_mix_part").alias("_mix_in"), "_mix_end"), "ends")
    same = F.col("source").eqNullSafe(F.col("_mix_from")) & (F.col("_mix_block") == F.col("_mix_at")) & (F.col("_mix_part") == F.col("_mix_in"))
    rows = _dealt(own, shares, seed, block_rows).join(_few(ends), same, "left")
    more = F.coalesce(F.struct(_key(last, seed).alias("_mix_key"), F.col("_mix_row")) <= F.col("_mix_end"), F.lit(False))
    times = last + F.when(more, F.lit(1)).otherwise(F.lit(0))
    each = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))
    return rows.select("_row", each.alias("_mix_time")).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
