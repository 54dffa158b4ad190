"""Connected components by alternating stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions


def _star(edges: DataFrame, large: bool, bound: float | None) -> DataFrame:
    """Ties the larger (or the other) neighbours of each node to its least neighbour. Nodes with more
    than ``bound`` edges would fill one task of the join each; they are few, so what they tie to is
    broadcast. None: there are none."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
    if bound is None:
        tied = both.join(least, "u")
    else:
        hot = F.broadcast(least.where(F.col("c") > bound))
        tied = both.join(hot, "u").unionByName(both.join(hot.select("u"), "u", "left_anti").join(least, "u"))
    if large:
        tied = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return tied.where(F.col("u") > F.col("v")).distinct()


def _bound(edges: DataFrame, size: int, n: int) -> float | None:
    """Over 1000 edges and over one in 8 n of all ends: fewer than 8 n nodes have so many. None
    where no node has. A round gives no node more edges than it had in this measure."""
    bound = max(1000, size / (4 * n))
    if 2 * size <= bound:
        return None
    degrees = edges.select(F.explode(F.array("u", "v")).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    return bound if degrees.agg(F.max("c")).first()[0] > bound else None


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have edges (u, v); the component is its least node."""
    n = partitions(scratch.spark)
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{name}-0")
    size, mark = now.count(), None
    for k in range(1, most_rounds + 1):
        bound = _bound(now, size, n)
        now = scratch.write(_star(_star(now, True, bound), False, bound), f"{name}-{k}")
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{name}-{k - 1}")
        if tuple(row) == mark:
            break
        mark, size = tuple(row), row[0]
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
