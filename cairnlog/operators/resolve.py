"""Which version of a key counts: the newest, and then whether it is live.

Filters on the key may move below these operators, and Spark moves them; filters on the value or
on deletion may not: they would bring older versions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` for each `by`; each task sends one row a key, so hot keys are no hot partition."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones among them."""
    return newest(log, ["key"], ["seq"])


def is_dead(dialect: str = "flag") -> Column:
    """flag: what was deleted. log: also what was put with an empty value, which a replayed log can't tell from a delete."""
    if dialect == "flag":
        return F.col("deleted")
    if dialect == "log":
        return F.col("deleted") | (F.coalesce(F.octet_length("value"), F.lit(0)) == 0)
    raise ValueError(f"no such dialect: {dialect}")


def live(log: DataFrame, dialect: str = "flag") -> DataFrame:
    """The newest version of each key that is not dead."""
    return latest(log).where(~is_dead(dialect))
