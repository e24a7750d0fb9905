"""Nearest neighbours by inner product with a forest of random-projection trees.

Vectors get one more component that makes their lengths equal, after which the largest inner
product is the least distance. Trees are fitted on the driver on a bounded sample: a node splits at
the median of a projection onto the line through two random points of its own. Sample and depth grow
with the table, so that a leaf holds about as many vectors as there are leaves, up to LEAVES. Every
distinct vector is then filed under a leaf of each tree.

A query searches all trees through one priority queue: it pops the node with the best priority, the
least signed margin on the path to it, follows its own side down to a leaf, which it visits, and pushes
the other sides that it passes. It ends at a priority below -share * r, where r bounds the distance of
the query's last wanted neighbour by its neighbours in the sample; nothing below that end is looked
at. A share of 1 would miss nothing, as a margin is a distance; the share in use is calibrated on
sample queries so that TARGET of the true neighbours are met (a target of 1 keeps the share at 1), and so
adapts to clustered and to shapeless data, and each query to its own surroundings. The candidates of
the visited leaves are ranked by exact products.

Leaves meet their queries in cells of at most CELL_ROWS vectors and CELL_ROWS queries, so no task
holds a whole leaf. Equal vectors are one; it carries its smallest ids, as ties go to smaller ids
and no query can use more. Nothing is capped: beyond a cell's size there are more cells.

Defined results: vectors that are null, zero, of another length than most, or with null or
non-finite components take no part; rows with the same id and vector are one candidate; with fewer
candidates than wanted all are returned; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.llm.common import written

TREES = 4
#: Leaves of a tree, at most, and vectors of the sample for each: the sample has LEAVES * LEAF distinct vectors at most, 8192 at least.
LEAVES, LEAF, LEAST_SAMPLE = 4096, 16, 8192
#: Share of true neighbours that the calibrated search meets on the sample.
TARGET = 0.95
CALIBRATED_ON = 256
CELL_ROWS = 4096


class Forest:
    """Perfect binary trees: normals[tree, node], bounds[tree, node]; node i has 2i+1 below the bound and 2i+2 above."""

    def __init__(self, x: np.ndarray, leaves: int, trees: int = TREES, seed: int = 0):
        r = np.random.default_rng(seed)
        self.depth = max(0, math.ceil(math.log2(max(1, min(leaves, len(x) / 2)))))
        nodes = 2**self.depth - 1
        self.normals = np.zeros((trees, nodes, x.shape[1]))
        self.bounds = np.zeros((trees, nodes))
        for t in range(trees):
            parts = {0: np.arange(len(x))}
            for i in range(nodes):
                rows = parts.pop(i)
                line = r.standard_normal(x.shape[1])
                for _ in range(4):
                    if len(rows) > 1:
                        a, b = r.choice(rows, 2, replace=False)
                        if (x[a] != x[b]).any():
                            line = x[a] - x[b]
                            break
                self.normals[t, i] = line / np.linalg.norm(line)
                p = x[rows] @ self.normals[t, i]
                self.bounds[t, i] = np.median(p) if len(p) else 0.0
                below = p < self.bounds[t, i]
                parts[2 * i + 1], parts[2 * i + 2] = rows[below], rows[~below]

    @property
    def leaves(self) -> int:
        return 2**self.depth

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: [vector, tree]."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", x, self.normals[t, at]) >= self.bounds[t, at]
                at = 2 * at + 1 + above
            out[:, t] = at - (self.leaves - 1)
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        """[query, tree, node]: the signed margins, which a search reads where it passes; one product for a batch of queries."""
        return np.einsum("tnd,qd->qtn", self.normals, q, optimize=True) - self.bounds

    def popped(self, margin: np.ndarray, least: float):
        """(priority, tree * leaves + leaf) of one query's leaves, best first, as long as the priority is `least` or more.

        One queue serves all trees. A popped node is followed down the query's own side to a leaf; where that path
        turns, the other side goes into the queue with the least signed margin on the path to it.
        """
        nodes, first = self.leaves - 1, [m.tolist() for m in margin]
        queue = [(-math.inf, t, 0) for t in range(len(first))]
        while queue:
            key, t, at = heapq.heappop(queue)
            m = first[t]
            while at < nodes:
                away = abs(m[at])
                own = 2 * at + 1 + (m[at] >= 0)
                if -max(key, away) >= least:
                    heapq.heappush(queue, (max(key, away), t, 4 * at + 3 - own))
                at = own
            yield -key, t * self.leaves + at - nodes


class Index:
    """A forest over lengthened vectors, the sample it was fitted on, and the calibrated share."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, longest: float, wanted: int, leaves: int, target: float = TARGET, seed: int = 0):
        self.sample, self.ids, self.longest, self.wanted = sample, ids, longest, wanted
        self.forest = Forest(self.lengthened(sample), leaves, seed=seed)
        self.leaf = self.forest.file(self.lengthened(sample))
        self.share = 1.0
        some = np.random.default_rng(seed + 1).permutation(len(sample))[:CALIBRATED_ON]
        if target < 1 and len(sample) > wanted + 1 and self.forest.depth:
            q = sample[some]
            score = q @ sample.T
            score[np.arange(len(some)), some] = -np.inf
            near = np.argpartition(-score, wanted - 1, 1)[:, :wanted]
            cell = self.leaf + self.forest.leaves * np.arange(self.leaf.shape[1])
            met = np.empty(near.shape)
            for i, margin in enumerate(self.forest.margins(self.asked(q))):
                prio = np.empty(cell.shape[1] * self.forest.leaves)
                for p, c in self.forest.popped(margin, -math.inf):
                    prio[c] = p
                met[i] = prio[cell[near[i]]].max(1)
            needed = np.maximum(0.0, -met) / self.bound(self._scores(q, ids[some]), q)[:, None]
            self.share = min(1.0, float(np.quantile(needed, target)) + 1e-9)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))[:, None]])

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to the common length, which doesn't change their order of candidates."""
        return np.hstack([q * (self.longest / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])

    def _scores(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """[query, sample]: products, without a query's own."""
        score = q @ self.sample.T
        score[ids[:, None] == self.ids[None, :]] = -np.inf
        return score

    def _last(self, score: np.ndarray) -> np.ndarray:
        """The product of each query's last wanted neighbour among these; -inf where there are fewer."""
        if score.shape[1] < self.wanted:
            return np.full(len(score), -np.inf)
        return -np.partition(-score, self.wanted - 1, 1)[:, self.wanted - 1]

    def bound(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each query the largest distance that its last wanted neighbour can have."""
        last = self._last(score)
        scaled = np.where(np.isfinite(last), last, 0.0) * self.longest / np.linalg.norm(q, axis=1)
        far = np.sqrt(np.maximum(1e-12, 2 * self.longest**2 - 2 * scaled))
        return np.where(np.isfinite(last), far, np.inf)

    def visits(self, q: np.ndarray, ids: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """The leaves (tree * leaves + leaf) that each query visits, and each query's least product of use.

        That product is taken from sample vectors in visited leaves, which the search will meet, so as
        many as wanted are always found. A query whose leaves have too few of them visits all.
        """
        score, trees = self._scores(q, ids), np.arange(self.leaf.shape[1])
        far, cell = self.bound(score, q), self.leaf + self.forest.leaves * trees
        limit = np.where(np.isinf(far), -np.inf, -self.share * np.where(np.isinf(far), 1.0, far))
        out, least = [], np.empty(len(q))
        for i, margin in enumerate(self.forest.margins(self.asked(q))):
            found = [c for _, c in self.forest.popped(margin, limit[i])]
            seen = np.zeros(len(trees) * self.forest.leaves, bool)
            seen[found] = True
            least[i] = self._last(np.where(seen[cell].any(1), score[i], -np.inf)[None, :])[0]
            out.append(found if np.isfinite(least[i]) else list(range(len(seen))))
        return out, least


def _valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull())
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def search(vectors: DataFrame, is_query: Column, wanted: int, id_col: str = "vec_id", vector: str = "embedding", leaves: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the nearest found of every row where is_query (of the column `id`)."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    rows = _valid(vectors, id_col, vector).select("id", "v", *key, is_query.alias("asks"))
    least = Window.partitionBy("k1", "k2").orderBy("id")
    ids = rows.select("k1", "k2", "id").withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= wanted + 1)
    ids = ids.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    one = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.bool_or("asks").alias("asks"))
    points = written(one.join(ids, ["k1", "k2"]), "points")

    square = F.reduce("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, many = points.agg(F.max(square), F.count(F.lit(1))).first()
    if not many:
        return none
    longest = math.sqrt(most) * (1 + 1e-12)
    leaves = leaves or min(LEAVES, math.ceil(math.sqrt(many)))  # as many vectors in a leaf as leaves
    sample = max(LEAST_SAMPLE, LEAF * leaves)
    picked = points.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    index = Index(_matrix(picked.column("v")), picked.column("rep").to_numpy(), longest, wanted, leaves, target)
    kind = rows.schema["v"].dataType.simpleString()

    def filed(batches):
        for b in batches:
            leaf = index.forest.file(index.lengthened(_matrix(b.column("v")))) + index.forest.leaves * np.arange(TREES)
            cells = pa.ListArray.from_arrays(np.arange(0, leaf.size + 1, TREES, dtype=np.int32), leaf.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), b.column("ids"), cells], ["rep", "v", "ids", "cells"])

    def asked(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                visits, least = index.visits(_matrix(part.column("v")), part.column("rep").to_numpy())
                cells = pa.array(visits, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("v"), pa.array(least), cells], ["rep", "v", "least", "cells"])

    members = points.select("rep", "v", "ids").mapInArrow(filed, f"rep long, v {kind}, ids array<long>, cells array<int>")
    asking = points.where("asks").select("rep", "v").mapInArrow(asked, f"rep long, v {kind}, least double, cells array<int>")
    members, asking = written(members, "members"), written(asking, "asking")

    # cells of a leaf: so many that none has more than CELL_ROWS vectors or queries; a row for each leaf of the forest
    sizes = lambda t: dict(t.select(F.explode("cells").alias("c")).groupBy("c").count().collect())
    across, down = ([max(1, -(-n.get(c, 0) // CELL_ROWS)) for c in range(TREES * index.forest.leaves)] for n in (sizes(members), sizes(asking)))

    def dealt(table: DataFrame, own: list[int], other: list[int], mine: str, theirs: str) -> DataFrame:
        table = table.withColumn("c", F.explode("cells")).drop("cells")
        at = lambda n: F.get(F.split(F.lit(",".join(map(str, n))), ",").cast("array<int>"), F.col("c"))
        table = table.withColumn(mine, F.pmod(F.xxhash64("rep", F.lit(3)), at(own)).cast("int"))
        return table.withColumn(theirs, F.explode(F.sequence(F.lit(0), at(other) - 1)))

    left = dealt(members, across, down, "a", "d").groupBy("c", "a", "d")
    right = dealt(asking, down, across, "d", "a").groupBy("c", "a", "d")

    def meet(_, have: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if have.num_rows and ask.num_rows:
            x, q, least = _matrix(have.column("v")), _matrix(ask.column("v")), ask.column("least").to_numpy()
            for i in range(0, len(q), 512):
                score = q[i : i + 512] @ x.T
                floor = least[i : i + 512]
                if len(x) > wanted + 1:
                    floor = np.maximum(floor, -np.partition(-score, wanted, 1)[:, wanted])
                # a hair below, as the products are added up in another order here
                r, c = np.nonzero(score >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
                out.append((r + i, c, (q[r + i] * x[c]).sum(1)))
        r, c, s = (np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": ask.column("rep").take(pa.array(r)), "ids": have.column("ids").take(pa.array(c)), "score": pa.array(s)})

    found = left.cogroup(right).applyInArrow(meet, "q long, ids array<long>, score double")
    found = found.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= wanted + 1)
    askers = rows.where("asks").select(F.col("id").alias("query_id"), "k1", "k2").distinct()
    askers = askers.join(points.where("asks").select("k1", "k2", F.col("rep").alias("q")), ["k1", "k2"]).select("query_id", "q")
    ranked = askers.join(best.drop("n"), "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
