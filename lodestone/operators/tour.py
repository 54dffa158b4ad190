"""Cheapest closed tours through candidate arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cheapest_tours(loops: DataFrame) -> DataFrame:
    """(g, cost, n, arcs): per loop the cheapest way round through its candidate arcs, its number of
    arcs, and their numbers in order of their starts; loops that no arcs close are left out.

    ``loops``: (g, m, arcs, joints). ``arcs`` lists (start, len, cost, smooth_in, smooth_out) of arcs
    from a vertex of 0 to m - 1 over ``len`` steps; ``joints`` lists by vertex (smooth, corner), the
    price of a vertex where two arcs meet, smooth if both are smooth there. Costs are whole numbers,
    so equal ones are equal; among them the tour of fewer arcs counts, then the one of lower numbers.

    Every vertex is tried as the place where the tour begins, with either end: a row each. From there
    arcs are taken in the order of their starts, and a fold keeps for each position the cheapest way
    to come to it smoothly or at a corner."""
    numbered = F.transform("arcs", lambda a, k: F.struct(a["start"].alias("start"), a["len"].alias("len"), a["cost"].cast("long").alias("cost"), a["smooth_in"].alias("i"), a["smooth_out"].alias("o"), k.alias("k")))
    seams = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    rows = loops.select("g", "m", "joints", numbered.alias("arcs")).withColumn("seam", seams).withColumn("first", F.explode(F.array(F.lit(False), F.lit(True))))
    m, seam, first = F.col("m"), F.col("seam"), F.col("first")
    placed = F.transform("arcs", lambda a: F.struct(F.pmod(a["start"] - seam, m).alias("p"), a["k"].alias("k"), a["start"].alias("start"), a["len"].alias("len"), a["cost"].alias("cost"), a["i"].alias("i"), a["o"].alias("o")))
    fits = F.filter(placed, lambda a: (a["p"] + a["len"] <= m) & ((a["p"] > 0) | (a["i"] == first)))
    rows = rows.withColumn("way", F.array_sort(fits))
    none = F.struct(F.lit(None).cast("long").alias("cost"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("arcs"))
    joint = lambda v, smooth: F.when(smooth, F.get("joints", v)["smooth"]).otherwise(F.get("joints", v)["corner"]).cast("long")

    def taken(before: Column, a: Column, price: Column) -> Column:
        """The way on from one that exists."""
        return F.when(before["cost"].isNotNull(), F.struct((before["cost"] + price + a["cost"]).alias("cost"), (before["n"] + 1).alias("n"), F.array_append(before["arcs"], a["k"]).alias("arcs")))

    def relax(state: Column, a: Column) -> Column:
        at = lambda smooth: F.get(state, a["p"] * 2 + (1 if smooth else 0))
        begin = F.struct(a["cost"].alias("cost"), F.lit(1).alias("n"), F.array(a["k"]).alias("arcs"))
        new = F.when(a["p"] == 0, begin).otherwise(F.least(taken(at(False), a, joint(a["start"], F.lit(False))), taken(at(True), a, joint(a["start"], a["i"]))))
        to = (a["p"] + a["len"]) * 2 + a["o"].cast("int")
        return F.transform(state, lambda s, k: F.when((k == to) & new.isNotNull() & (s["cost"].isNull() | (new < s)), new).otherwise(s))

    ends = F.aggregate("way", F.array_repeat(none, m * 2 + 2), relax)
    rows = rows.select("g", "joints", "seam", "first", F.slice(ends, -2, 2).alias("ends"))
    close = lambda e, smooth: F.when(e["cost"].isNotNull(), F.struct((e["cost"] + joint(seam, smooth)).alias("cost"), e["n"].alias("n"), F.array_sort(e["arcs"]).alias("arcs")))
    best = F.least(close(F.get("ends", F.lit(0)), F.lit(False)), close(F.get("ends", F.lit(1)), first))
    return rows.groupBy("g").agg(F.min(best).alias("b")).where("b is not null").select("g", "b.cost", "b.n", "b.arcs")
