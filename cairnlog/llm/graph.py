"""Connected components by contraction, with no collect and no group gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.llm.common import forget, written


#: A table is broadcast up to this many rows (two numbers each), counted first; a key is hot from so many rows on.
BROADCAST_ROWS, HOT_ROWS = 1_000_000, 100_000


def _looked_up(rows: DataFrame, table: DataFrame, key: str, size: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of `size` rows that has each key once, however many rows have the same key.

    A small table is broadcast. Beside a large one the rows of hot keys, of which there are few, are looked
    up in a broadcast part of it; the others are joined by the key.
    """
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    hot = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT_ROWS).select(key), "hot")
    few = F.broadcast(hot)  # at most a row for each HOT_ROWS rows
    own = rows.join(few, key, "left_anti").join(table, key, how)
    return own.unionByName(rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a long, b long); nodes of one component have one root, a node of it.

    A round maps every node to its neighbourhood's first node in a random (hashed) order, follows
    that once more, and replaces edges by the edges between the images, which are far fewer. Each
    step is an aggregate with partial sums or a lookup (`_looked_up`), so that no task gets all rows
    of a node with very many edges. Rounds grow with the logarithm of the nodes.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    place = written(nodes.select("node", F.col("node").alias("root")), "place")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        step = (
            both.groupBy("a")
            .agg(F.min(first("b")).alias("m"))
            .select("a", F.least("m", first("a"))["v"].alias("to"))
        )
        step = written(step, "step")
        n = step.count()
        jump = _looked_up(step, step.select(F.col("a").alias("to"), F.col("to").alias("on")), "to", n).select("a", "on")
        jump = written(jump, "jump")
        image = lambda old, new: jump.select(F.col("a").alias(old), F.col("on").alias(new))
        kept, was = edges, place
        edges = written(
            _looked_up(_looked_up(edges, image("a", "x"), "a", n), image("b", "y"), "b", n)
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
        place = written(
            _looked_up(place, image("root", "x"), "root", n, "left").select("node", F.coalesce("x", "root").alias("root")), "place"
        )
        for old in (kept, was, step, jump):
            forget(old)
    return place
