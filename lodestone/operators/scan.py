"""Scan conversion: filled outlines become coverage of pixels, and layers of coverage a picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closed_edges(points: DataFrame, key: list[str], ring: Column | None = None) -> DataFrame:
    """(key, x0, y0, x1, y1) of the closed outlines of points (key, i, x, y); the last meets the first,
    but for those that ``ring`` says are open."""
    w = Window.partitionBy(*key).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("x", "y")).over(whole)
    to = F.coalesce(F.lead(F.struct("x", "y")).over(w), first if ring is None else F.when(ring, first))
    return points.withColumn("to", to).where("to is not null").select(*key, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("to.x").alias("x1"), F.col("to.y").alias("y1"))


def flattened(segments: DataFrame, key: list[str], pieces: int = 8) -> DataFrame:
    """(key, x0, y0, x1, y1): edges of filled rings from cubic segments (key, ring, seg, kind, x0 .. y3).
    A curve becomes so many straight pieces, a straight segment stays one; a ring that is left open is
    closed from its end to its start."""
    n = F.when(F.col("kind").isin("L", "Z"), 1).otherwise(pieces)
    t = lambda k: k / n

    def on(axis: str, k: Column) -> Column:
        a, b, c, d = (F.col(f"{axis}{i}") for i in range(4))
        u = 1 - t(k)
        curve = u * u * u * a + 3 * u * u * t(k) * b + 3 * u * t(k) * t(k) * c + t(k) * t(k) * t(k) * d
        return F.when(k == 0, a).when(k == n, d).otherwise(curve)

    step = lambda k: F.struct(*[on(axis, k + side).alias(f"{axis}{side}") for side in (0, 1) for axis in "xy"])
    edges = segments.select(*key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), step)).alias("e")).select(*key, "e.*")
    end = lambda f, i: f(F.struct("seg", F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")))
    ring = segments.groupBy(*key, "ring").agg(end(F.max, 3).alias("a"), end(F.min, 0).alias("b"))
    return edges.unionByName(ring.select(*key, F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1")))


def coverage(edges: DataFrame, key: list[str], width: int, height: int, even_odd: bool = False, rows: int = 4) -> DataFrame:
    """(key, x, y, coverage): the share of each pixel inside the outlines of a key, nonzero or even-odd.

    A pixel row is cut into ``rows`` lines; on a line the edges (x0, y0, x1, y1) that cross it are put
    in order, a running sum gives the winding, and the spans inside cover pixels by exact lengths.
    Work is in proportion to crossings and to pixels that spans touch."""
    # an edge holds its upper end and not its lower one, so a vertex on a line counts once
    first, last = (F.ceil(f("y0", "y1") * rows - 0.5) for f in (F.least, F.greatest))
    e = edges.withColumns({"__from": F.greatest(first, F.lit(0)), "__to": F.least(last - 1, F.lit(height * rows - 1))})
    e = e.where("__from <= __to").withColumn("line", F.explode(F.sequence("__from", "__to")))
    level = (F.col("line") + 0.5) / rows
    e = e.select(*key, "line", (F.col("x0") + (F.col("x1") - F.col("x0")) * ((level - F.col("y0")) / (F.col("y1") - F.col("y0")))).alias("at"), F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1).alias("dir"))
    w = Window.partitionBy(*key, "line").orderBy("at", "dir")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.row_number().over(w) % 2 == 1 if even_odd else F.sum("dir").over(so_far) != 0
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(float(width)), c))
    spans = e.select(*key, "line", clip(F.col("at")).alias("a"), clip(F.lead("at").over(w)).alias("b"), inside.alias("inside")).where("inside and b > a")
    pixels = F.sequence(F.floor("a"), F.least(F.floor("b"), F.lit(width - 1)))
    p = spans.withColumn("x", F.explode(pixels))
    part = F.greatest(F.lit(0.0), F.least(F.col("b"), F.col("x") + 1.0) - F.greatest(F.col("a"), F.col("x").cast("double"))) / rows
    out = p.groupBy(*key, F.col("x").cast("int").alias("x"), F.floor(F.col("line") / rows).cast("int").alias("y")).agg(F.sum(part).alias("coverage"))
    return out.where("coverage > 0")


def composited(layers: DataFrame, key: list[str], order: str, tone: str, under: Column | float = 255.0) -> DataFrame:
    """(key, x, y, level): layers (order, tone, coverage) laid over each other from the lowest order on."""
    stack = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.least(F.lit(1.0), F.col("coverage")).alias("c"), F.col(tone).cast("double").alias("t"))))
    start = under if isinstance(under, Column) else F.lit(float(under))
    return layers.groupBy(*key, "x", "y").agg(F.aggregate(stack, start, lambda v, s: v * (1 - s["c"]) + s["t"] * s["c"]).alias("level"))
