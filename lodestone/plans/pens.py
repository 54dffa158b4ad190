"""Queries of strokes turned into outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan as R
from ..operators.stroke import outlined
from ..sources.roles import dealt, table
from .registry import query

#: A vector's first twelve components are a polyline of six points; its width follows its label.
LINES = """pt AS (SELECT vec_id AS g, i, 32 + 80 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 32 + 80 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y, 1 + label / 2.0 AS w FROM embeddings, range(6) t(i)),
dr AS (SELECT *, (lead(x) OVER s - x) / sqrt(pow(lead(x) OVER s - x, 2) + pow(lead(y) OVER s - y, 2)) AS ox, (lead(y) OVER s - y) / sqrt(pow(lead(x) OVER s - x, 2) + pow(lead(y) OVER s - y, 2)) AS oy FROM pt WINDOW s AS (PARTITION BY g ORDER BY i)),
nb AS (SELECT *, lag(ox) OVER s AS ix, lag(oy) OVER s AS iy FROM dr WINDOW s AS (PARTITION BY g ORDER BY i)),
leg AS (SELECT g, s AS s, s * i AS pos, n, CASE n WHEN 0 THEN x - s * w / 2 * iy WHEN 1 THEN x ELSE x - s * w / 2 * oy END AS x, CASE n WHEN 0 THEN y + s * w / 2 * ix WHEN 1 THEN y ELSE y + s * w / 2 * ox END AS y
 FROM nb, (VALUES (1), (-1)) a(s), range(3) b(n) WHERE CASE n WHEN 0 THEN ix IS NOT NULL WHEN 2 THEN ox IS NOT NULL ELSE ix IS NOT NULL AND ox IS NOT NULL AND s * (ix * oy - iy * ox) > 0 END),
og AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, pos, s * n) AS i FROM leg),
cl AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM og WINDOW o AS (PARTITION BY g ORDER BY i))"""


#: Strokes that are painted in one task: their edges on all lines of the picture fit its memory.
STROKES = 2048


def _lines(spark, sf, together: int | None = None):
    """Points of the polylines; with ``together`` vectors are dealt into tasks of about so many."""
    e = F.col("embedding")
    p = F.array(*[F.struct(F.lit(i).alias("i"), *[(32 + 80 * e[2 * i + c].cast("double")).alias(n) for c, n in enumerate("xy")]) for i in range(6)])
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 12).alias("embedding"))
    if together:
        vectors = dealt(vectors, together, "vec_id")
    return vectors.select(F.col("vec_id").alias("g"), (1 + F.col("label") / 2).alias("w"), F.explode(p).alias("p")).select("g", "w", "p.*")


@query(f"WITH {LINES} SELECT g, count(*) AS nodes, round(sum(x * ny - nx * y) / 2, 5) AS area, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 5) AS length FROM cl GROUP BY 1")
def stroke_outlines(spark, sf):
    """Outlines of strokes with bevelled joins and flat ends: their nodes, signed area and length."""
    o = R.closed_edges(outlined(_lines(spark, sf), ["g"], "w", join="bevel"), ["g"])
    step = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return o.groupBy("g").agg(F.count("*").alias("nodes"), F.round(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2, 5).alias("area"), F.round(F.sum(step), 5).alias("length"))


@query()
def stroke_coverage(spark, sf):
    """Strokes of each vector painted with mitred, bevelled and round joins: pixels touched and ink."""
    kinds = [("miter", "butt"), ("bevel", "square"), ("round", "round")]
    out = None
    for join, cap in kinds:
        # vectors are dealt, so that all windows of a stroke find it in one place; the edges are never shuffled
        rings = outlined(_lines(spark, sf, STROKES), ["g"], "w", join, cap)
        c = R.coverage(R.closed_edges(rings, ["g"]), ["g"], 64, 64)
        one = c.groupBy("g").agg(F.count("*").alias("pixels"), F.round(F.sum("coverage"), 5).alias("ink"))
        one = one.select("g", F.lit(join).alias("join"), "pixels", "ink")
        out = one if out is None else out.unionByName(one)
    return out
