"""Strokes as filled outlines: offset polylines with joins and caps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _arc(x: Column, y: Column, half: Column, start: Column, turn: Column, pieces: int) -> Column:
    """Points of an arc around (x, y) from an angle on, both ends with it."""
    at = lambda k: start + turn * k / pieces
    return F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda k: _xy(x + half * F.cos(at(k)), y + half * F.sin(at(k))))


def outlined(points: DataFrame, key: list[str], width: str, join: str = "miter", cap: str = "butt", limit: float = 4.0, pieces: int = 8) -> DataFrame:
    """(key, i, x, y): the outline of each open polyline (key, i, x, y, width) as one closed ring whose
    nonzero filling is the stroke: one side along the way, the cap, the other side back, the cap.

    Joins are "miter" (a bevel where the point would be over ``limit`` half widths away), "bevel" or
    "round", caps "butt", "square" or "round"; round ones are arcs of so many pieces. The inner side of
    a join goes over the vertex itself. Points that repeat the one before go; a polyline that has one
    point left has no outline. Each point needs its two neighbours alone."""
    order = Window.partitionBy(*key).orderBy("i")
    px, py = F.lag("x").over(order), F.lag("y").over(order)
    p = points.withColumns({"__px": px, "__py": py}).where("__px is null or x <> __px or y <> __py")
    dx, dy = F.lead("x").over(order) - F.col("x"), F.lead("y").over(order) - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    p = p.select(*key, "i", "x", "y", (F.col(width) / 2).cast("double").alias("h"), (dx / size).alias("ox"), (dy / size).alias("oy"))
    p = p.withColumns({"ix": F.lag("ox").over(order), "iy": F.lag("oy").over(order)}).where("ox is not null or ix is not null")
    x, y, h, ix, iy, ox, oy = (F.col(c) for c in ("x", "y", "h", "ix", "iy", "ox", "oy"))
    cross, dot = ix * oy - iy * ox, ix * ox + iy * oy
    p = p.withColumns({"cross": cross, "dot": dot, "turn": F.atan2(cross, dot)})
    cross, dot, turn = F.col("cross"), F.col("dot"), F.col("turn")

    def side(s: int) -> Column:
        """Points of one side of an inner vertex, in the direction of the way."""
        before, after = _xy(x - s * h * iy, y + s * h * ix), _xy(x - s * h * oy, y + s * h * ox)
        bevel = F.array(before, after)
        if join == "round":
            outer = _arc(x, y, h, F.atan2(s * ix, -s * iy), turn, pieces)
        elif join == "miter":
            reach = s * h / (1 + dot)
            point = F.array(_xy(x - reach * (iy + oy), y + reach * (ix + ox)))
            outer = F.when((dot > -1 + 1e-9) & (F.sqrt(2 / (1 + dot)) <= limit), point).otherwise(bevel)
        else:
            outer = bevel
        return F.when(s * cross < 0, outer).when(cross == 0, F.when(dot > 0, F.array(after)).otherwise(outer)).otherwise(F.array(before, _xy(x, y), after))

    def end(ux: Column, uy: Column) -> Column:
        """The cap at an end that the way leaves in direction (ux, uy), from its left side to its right."""
        if cap == "round":
            return _arc(x, y, h, F.atan2(ux, -uy), F.lit(-math.pi), pieces)
        on = 1 if cap == "square" else 0
        return F.array(*[_xy(x - s * h * uy + on * h * ux, y + s * h * ux + on * h * uy) for s in (1, -1)])

    there = F.when(F.col("ox").isNull(), end(ix, iy)).when(F.col("ix").isNull(), F.array().cast("array<struct<x:double,y:double>>")).otherwise(side(1))
    back = F.when(F.col("ix").isNull(), end(-ox, -oy)).when(F.col("ox").isNull(), F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.reverse(side(-1)))
    leg = lambda k, i, pts: F.transform(pts, lambda q, n: F.struct(F.struct(F.lit(k).alias("leg"), i.alias("at"), n.alias("n")).alias("ord"), q["x"].alias("x"), q["y"].alias("y")))
    out = p.select(*key, F.explode(F.concat(leg(0, F.col("i").cast("long"), there), leg(1, -F.col("i").cast("long"), back))).alias("q"))
    return out.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("q.ord")).alias("i"), "q.x", "q.y")
