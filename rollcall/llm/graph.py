"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two equi-joins over the edge table; no
neighbour list is ever gathered, so a node with millions of edges is a row count
and not a group. Rounds are cut by ``checkpoint`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _is_forest_of_stars(e: DataFrame) -> bool:
    two = e.groupBy("u").count().where("count > 1").limit(1)
    inner = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
    return not two.select("u").union(inner.select("u")).limit(1).count()


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): each node that isn't the least of its component, with that least node.

    ``edges`` has two columns of one ordered type. Raises if ``rounds``, far more
    than the logarithm of any node count, don't settle it.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = checkpointed(e, thin=True)
    for _ in range(rounds):
        if _is_forest_of_stars(e):
            return e
        e = checkpointed(_small_star(_large_star(e)), thin=True)
    raise RuntimeError(f"components not settled after {rounds} rounds")
