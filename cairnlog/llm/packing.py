"""Best-fit packing of token pieces into sequences by bin completion.

Texts are tokenized, given an end token and cut into pieces where they exceed the sequence
length. How full sequences can be only depends on how many pieces there are of each length, a
table of at most `capacity` rows however large the corpus. So the plan is made from that table
on the driver and rows are then placed by rank:

* Bin completion: best-fit decreasing of the whole list is the first incumbent, and stands if it
  meets the lower bound. Else the search branches over sequences: each takes the largest length
  left and one of the undominated fillings of its gap (no larger piece left can stand for some of
  a filling's), the fullest first, as often as the counts allow and then less often. The waste that
  fewer sequences than the incumbent's leave bounds the fillings, the lower bound of what is left
  prunes, and the best-fit solution of what is left at each node is the next incumbent. The search is
  exact with nodes=None; by default it ends after NODES steps, when the incumbent stands.
* Every piece gets its rank among the pieces of its length: rows are dealt to (length, block)
  cells by a hash, ranked inside, and shifted by the earlier cells. The n-th piece of a length
  takes the n-th place that the plan has for it.

The plan's rows go to the executors with the last step; there are a few for each length, as each
filling uses up a length or leaves less of one than the filling takes.

Defined results: a null or empty text is the end token alone; repeated rows are placed each; an
empty table gives an empty result; texts are cut at exact multiples of the length, and other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.llm.common import gathered_batches, small_batches, written

CAPACITY = 4096
END = 1
#: Steps (pieces tried, and lengths left at each node) of the search for fewer sequences than the incumbent has, before that
#: stands. None: search to the end.
NODES = 500_000
#: Levels of the search that keep their fillings, and lengths that its memory of failed nodes has in all.
LIVE, REMEMBERED = 16, 200_000
#: Cells that the pieces of one length are dealt to for ranking, at least, and rows of a cell beyond which there are more.
BLOCKS, BLOCK_ROWS = 256, 100_000

#: Characters whose lower case, composition and word breaks need no context: chunks between white
#: space can be tokenized one by one and kept. A text with any other goes to the tokenizer whole.
PLAIN = re.compile("[\\t\\n\\r -\\xa9\\xab-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0132-\\u0148\\u014a-\\u017f\\u2010-\\u2027\\u20ac]*")


#: The tokenizer's own pieces of a plain text without white space: what is between them is nothing.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: How the vocabulary marks the last token of a word.
WORD_END = "</w>"
#: Characters of texts, and chunks of them, that are worked on at a time.
AT_A_TIME, CHUNKS = 1 << 22, 1 << 20


class ChunkTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    The tokenizer breaks at white space and at word borders and looks at nothing across them, so the
    ids of a plain text are those of its chunks. A batch's distinct chunks are looked up once each,
    new ones go to the tokenizer together, and the texts' ids are gathered by the chunks' numbers.
    Known chunks are kept, up to `keep`.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.known = keep, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith(WORD_END)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end token."""
        own = [t for t in texts if not self._plain(t)]
        slow = dict(zip(own, self._encode(own)))
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if t not in slow:
                if some and size + len(t) > AT_A_TIME:
                    out += self._gathered(some)
                    some, size = [], 0
                some.append(t)
                size += len(t)
        out += self._gathered(some) if some else []
        plain = iter(out)
        return [slow[t] if t in slow else next(plain) for t in texts]

    def _gathered(self, texts: list[str]) -> list[bytes]:
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(each) if ids is None]
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            names = [distinct[j] for j in part]
            learned = self._learned(names)
            self.known.update(zip(names, learned))
            for j, ids in zip(part, learned):
                each[j] = ids
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, first = np.frombuffer(b"".join(each), "<u4"), np.cumsum(n) - n
        number, ids, ends = chunks.indices.to_numpy(), [], [np.zeros(1, np.int64)]
        for i in range(0, len(number), CHUNKS):
            k = number[i : i + CHUNKS]
            end = np.cumsum(n[k])
            ids.append(flat[np.repeat(first[k] - (end - n[k]), n[k]) + np.arange(end[-1])])
            ends.append(end + ends[-1][-1])
        raw = np.concatenate(ids).tobytes() if ids else b""
        at = (4 * np.concatenate(ends)[split.offsets.to_numpy()]).tolist()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """The ids of plain chunks, from one call: a chunk has as many word ends as words."""
        ids = np.frombuffer(self._encode([" ".join(chunks)])[0], "<u4")
        words = np.fromiter((1 if c.isalpha() else len(WORD.findall(c)) for c in chunks), np.int64, len(chunks))
        ends = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) - 1 != words.sum():  # another kind of vocabulary
            return self._encode(chunks)
        raw, at = ids.tobytes(), (4 * ends[np.append(0, np.cumsum(words))]).tolist()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    @staticmethod
    def _plain(text: str) -> bool:
        return "<|" not in text and PLAIN.fullmatch(text) is not None

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in got]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, so that its tasks share what is known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    last = end.to_bytes(4, "little")

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        for b in gathered_batches(batches, "text", AT_A_TIME):
            texts = [t or "" for t in b.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokenizer.ids(texts)):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: for every k, pieces above capacity - k share with none of k or more, and the rest need their room."""
    n = np.zeros(capacity + 1, np.int64)
    for x, m in counts.items():
        n[x] = m
    count, size = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    alone = count[-1] - count[capacity - k + 1]
    large, large_size = count[capacity - k + 1] - count[half + 1], size[capacity - k + 1] - size[half + 1]
    small_size = size[half + 1] - size[np.minimum(k, half + 1)]
    beyond = np.maximum(0, -(-(small_size - (large * capacity - large_size)) // capacity))
    return int((alone + large + beyond).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the whole list, a length at a time: fillings and how often each is used."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room left
    rooms: list[int] = []  # those of open_, ascending

    def add(room: int, bin_: tuple[int, ...], times: int) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((bin_, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):  # none has room: new ones, as full of x as can be
                each = min(n, capacity // x)
                add(capacity - each * x, (x,) * each, n // each)
                n -= each * (n // each)
                continue
            room = rooms[at]
            bin_, times = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(n, room // x)  # the tightest stays the tightest until it is too tight
            filled = min(times, n // each)
            add(room - each * x, bin_ + (x,) * each, filled)
            if times > filled:
                add(room, bin_, times - filled)
            n -= each * filled
    return [b for group in open_.values() for b in group]


def fillings(left: dict[int, int], gap: int, waste: int, tick=lambda: None):
    """Undominated fillings of `gap` that waste at most `waste`: the fullest first, of equals those with larger pieces.

    reach[i] has a bit for each sum that the i smallest lengths give, so a branch is entered only if the
    waste bound can still be met below it. `tick` is called at every step and may stop the search by raising.
    """
    lengths = sorted(x for x, n in left.items() if n > 0 and x <= gap)
    mask = (1 << (gap + 1)) - 1
    reach = [1]
    for x in lengths:
        sums, n, step = reach[-1], min(left[x], gap // x), 1
        while n > 0:  # 1, 2, 4, ... copies together
            take = min(step, n)
            sums |= sums << (x * take) & mask
            n, step = n - take, step * 2
        reach.append(sums)

    def exactly(total: int, i: int, chosen: list[int]):
        todo = [(total, i, 0, 0)]  # room, lengths to choose from, copies of the last, pieces chosen
        while todo:
            room, i, copies, depth = todo.pop()
            tick()
            del chosen[depth:]
            if copies:
                chosen.extend([lengths[i]] * copies)
            if not room:
                yield tuple(chosen)
                continue
            i = min(i, bisect_right(lengths, room))
            if not i:
                continue
            x = lengths[i - 1]
            depth = len(chosen)
            for n in range(min(left[x], room // x) + 1):  # most copies last, so that they are taken first
                if reach[i - 1] >> (room - n * x) & 1:
                    todo.append((room - n * x, i - 1, n, depth))

    for total in range(gap, max(-1, gap - waste - 1), -1):
        if reach[-1] >> total & 1:
            for found in exactly(total, len(lengths), []):
                if not dominated(found, left, lengths, gap - total):
                    yield found


def dominated(filling: tuple[int, ...], left: dict[int, int], lengths: list[int], slack: int) -> bool:
    """Whether one larger piece that is left can stand for some of the filling's: those then fit wherever it would have."""
    sums, i = 1, len(filling) - 1
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    for x in lengths:
        while i >= 0 and filling[i] < x:
            sums |= sums << filling[i]
            i -= 1
        if left[x] > used.get(x, 0):
            low = max(0, x - slack)
            if sums >> low & ((1 << (x - low + 1)) - 1):
                return True
    return False


class _Spent(Exception):
    """The search has used up its nodes."""


class _Level:
    """A sequence that the search fills: the fillings to come, how many were tried, and the one in use, so many times."""

    __slots__ = ("fillings", "tried", "barred", "room", "bin", "takes", "times")

    def __init__(self, room: int, barred: tuple[int, ...] | None):
        self.fillings, self.tried, self.barred, self.room = None, 0, barred, room
        self.bin, self.takes, self.times = (), None, 0


def _within(counts: dict[int, int], capacity: int, bins: int, nodes: int | None) -> tuple[list | None, bool, int]:
    """A plan of at most `bins` sequences if one is found, whether the answer is certain, and the nodes used.

    Depth first over sequences. A node fills one around the largest piece left, as often as the counts allow
    and then less often; the waste that `bins` sequences leave bounds its fillings. The best-fit solution of
    what is left ends a branch where it is good enough, and the lower bound of what is left where it is too high.
    What is left is changed in place, and only the last LIVE levels keep their list of fillings (an earlier one is
    made again where the search comes back to it), so memory hardly grows with the depth.
    """
    left, levels = dict(counts), []
    spent, failed, remembered = 0, {}, 0

    def tick(steps: int = 1) -> None:
        nonlocal spent
        spent += steps
        if nodes is not None and spent > nodes:
            raise _Spent

    def change(level: _Level, sign: int) -> None:
        for x, n in level.takes.items():
            left[x] = left.get(x, 0) + sign * n * level.times
            if not left[x]:
                del left[x]

    def options(level: _Level):
        top = max(left)
        rest = {**left, top: left[top] - 1}
        waste = level.room * capacity - sum(x * n for x, n in left.items())
        return (f for f in fillings(rest, capacity - top, waste, tick) if (top, *f) != level.barred)

    def opened(room: int, barred: tuple[int, ...] | None) -> list | None:
        """A plan of what is left, or None, with a new level if it is worth a search."""
        tick(len(left))
        if least_bins(left, capacity) > room or failed and failed.get(frozenset(left.items()), -1) >= room:
            return None
        rest = best_fit(left, capacity)
        if sum(n for _, n in rest) <= room:
            return rest
        levels.append(_Level(room, barred))
        if len(levels) > LIVE:
            levels[-LIVE - 1].fillings = None
        return None

    try:
        done = opened(bins, None)
        while levels and done is None:
            level = levels[-1]
            if level.takes is not None:
                change(level, 1)
                level.times -= 1
            if not level.times:
                if level.fillings is None:
                    level.fillings = islice(options(level), level.tried, None)
                found = next(level.fillings, None)
                if found is None:
                    if level.barred is None and remembered + len(left) <= REMEMBERED:
                        key = frozenset(left.items())
                        remembered += len(left)
                        failed[key] = max(level.room, failed.get(key, -1))
                    levels.pop()
                    continue
                level.tried += 1
                level.bin = (max(left), *found)
                level.takes = Counter(level.bin)
                level.times = min(level.room, *(left[x] // n for x, n in level.takes.items()))
            change(level, -1)
            # one time more was tried before, so the next sequence around the same piece is another one
            same = level.bin if left and max(left) == level.bin[0] else None
            done = opened(level.room - level.times, same)
        return (None if done is None else [*((v.bin, v.times) for v in levels), *done]), True, spent
    except _Spent:
        return None, False, spent


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, largest first) and how many sequences each is used for; every piece is placed once.

    Best-fit decreasing of the whole list is the first incumbent. Where it has more sequences than the lower bound,
    the search asks for as few as the bound, raises that as long as it proves them too few, and with what is left
    of its nodes asks for one less than the incumbent, again and again. nodes None searches to the end: the plan
    is then the best there is.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside of 1 to the capacity")
    if not left:
        return []
    best = best_fit(left, capacity)
    used, least = sum(n for _, n in best), least_bins(left, capacity)
    have = nodes
    while least < used:
        found, certain, spent = _within(left, capacity, least, None if have is None else have // 2)
        have = None if have is None else have - spent
        if found is not None:
            return found
        if not certain:
            break
        least += 1
    while least < used and have is not None and have > 0:
        found, _, spent = _within(left, capacity, used - 1, have)
        have -= spent
        if found is None:
            break
        best, used = found, sum(n for _, n in found)
    return best


def places(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): ranks of a length fill one place in successive sequences."""
    rows, rank, sequence = [], {}, 0
    for bin_, times in fillings:
        at = 0
        for x in bin_:
            rows.append((x, rank.get(x, 0), times, sequence, at))
            rank[x] = rank.get(x, 0) + times
            at += x
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, nodes: int | None = NODES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    numbered = written(pieces(docs, tokenizer_path, capacity, end).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    cut = numbered.drop("_row")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = places(plan(counts, capacity, nodes))
    blocks = [max(BLOCKS, -(-counts.get(n, 0) // BLOCK_ROWS)) for n in range(capacity + 1)]
    own = F.get(F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<int>"), F.col("length").cast("int"))
    # a row's number tells equal rows apart, so that they too are dealt to many cells
    by_block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", "ids_crc32", "_row"), own).cast("int")
    dealt = numbered.withColumn("_block", by_block)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "_row")) - 1
    ranked = dealt.withColumn("_rank", rank).join(cells, ["length", "_block"])
    ranked = ranked.select(
        *cut.columns, F.shiftleft("length", 48).bitwiseOR(F.col("_before") + F.col("_rank")).alias("_key")
    )
    return ranked.mapInArrow(_placed(rows), ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long")


def _placed(rows: list[tuple[int, int, int, int, int]]):
    """For each row of _key (length and rank in it) the place that the plan has for it."""
    rows = sorted(rows)
    keys = np.array([(r[0] << 48) | r[1] for r in rows], np.int64)
    first, sequence, offset = (np.array([r[i] for r in rows], np.int64) for i in (1, 3, 4))

    def run(batches):
        for b in batches:
            key = b.column("_key").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            kept = [c for c in b.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in kept),
                    pa.array(sequence[at] + (key & ((1 << 48) - 1)) - first[at]), pa.array(offset[at]),
                ],
                [*kept, "sequence_id", "offset"],
            )

    return run
