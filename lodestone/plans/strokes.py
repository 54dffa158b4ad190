"""Queries of stroke graphs and closed tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as H
from ..operators import skeleton as S
from ..operators.tour import cheapest_tours
from ..sources.roles import table
from ..sources.scratch import written
from .outlines import _chains
from .registry import query


#: Numbers of the places of so many images.
BLOCK = 16 * H.WIDE * H.WIDE


def _graph(spark, sf):
    """The boundary networks without the edges that border the outside: nodes with a radius from their
    place, and edges with their length."""
    c = written(_chains(spark, sf), "stroke-chains").where("not closed and least(left, right) >= 0")
    node = (F.col("img_id") * H.WIDE + F.col("y")) * H.WIDE + F.col("x")
    end = lambda f, c: f(F.struct("ord", node.alias("node")))["node"].alias(c)
    edges = c.groupBy(F.col("chain").alias("id")).agg(end(F.min, "a"), end(F.max, "b"), (F.count("*") - 1).alias("len"), F.lit(None).cast("double").alias("tip_a"), F.lit(None).cast("double").alias("tip_b"))
    edges = written(edges, "stroke-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("r", 0.5 + F.col("id") % 3 * 0.75)
    return nodes, edges


@query()
def pruned_strokes(spark, sf):
    """Edges that are left when short spurs are dropped and the nodes that this leaves with two edges
    or one are dissolved."""
    nodes, edges = _graph(spark, sf)
    return S.prune_spurs(nodes, edges, lambda df: written(df, "pruned"), block=4 * BLOCK).select("id", "a", "b", "len", "parts", "closed")


@query()
def contracted_strokes(spark, sf):
    """Clusters of nodes that short links tie together, with their edges to others."""
    nodes, edges = _graph(spark, sf)
    held, left = S.contract_links(nodes, edges, lambda df: written(df, "contracted"), block=BLOCK)
    ends = left.select(F.explode(F.array("a", "b")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("ends"))
    return held.groupBy("cluster").agg(F.count("*").alias("nodes"), F.max("r").alias("r")).join(ends, "cluster", "left").select("cluster", "nodes", "r", F.coalesce("ends", F.lit(0)).alias("ends"))


#: A vector's first sixteen components are a loop of eight points on a grid; arcs reach over one to
#: three steps and cost what they pass by.
LOOPS = """v AS MATERIALIZED (SELECT vec_id AS g, i, floor(100 * CAST(embedding[2 * i + 1] AS DOUBLE))::BIGINT AS x, floor(100 * CAST(embedding[2 * i + 2] AS DOUBLE))::BIGINT AS y FROM embeddings, range(8) t(i)),
far AS (SELECT a.g, a.i AS start, n.len, sum(abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) // 50)::BIGINT AS off FROM v a JOIN (SELECT unnest([2, 3]) AS len) n ON true JOIN v b ON b.g = a.g AND b.i = (a.i + n.len) % 8
 JOIN v p ON p.g = a.g AND (p.i - a.i + 8) % 8 BETWEEN 1 AND n.len - 1 GROUP BY 1, 2, 3),
arc AS MATERIALIZED (SELECT g, i AS start, 1 AS len, 30 AS cost, false AS si, false AS so FROM v UNION ALL SELECT g, start, len, 34 + off, true, true FROM far UNION ALL SELECT g, start, len, 39 + off, false, true FROM far),
joint AS MATERIALIZED (SELECT a.g, a.i, abs((a.x - z.x) * (b.y - a.y) - (a.y - z.y) * (b.x - a.x)) // 100 AS smooth, 12 AS corner FROM v a JOIN v z ON z.g = a.g AND z.i = (a.i + 7) % 8 JOIN v b ON b.g = a.g AND b.i = (a.i + 1) % 8)"""


@query(f"""WITH RECURSIVE {LOOPS}, way AS (SELECT g, start AS seam, si AS first, len AS p, so AS t, cost::BIGINT AS cost, 1 AS n FROM arc
 UNION ALL SELECT w.g, w.seam, w.first, w.p + a.len, a.so, w.cost + a.cost + CASE WHEN w.t AND a.si THEN j.smooth ELSE j.corner END, w.n + 1 FROM way w JOIN arc a ON a.g = w.g AND a.start = (w.seam + w.p) % 8 AND w.p + a.len <= 8 JOIN joint j ON j.g = w.g AND j.i = a.start WHERE w.p < 8),
whole AS (SELECT w.g, w.n, w.cost + CASE WHEN w.t AND w.first THEN j.smooth ELSE j.corner END AS cost FROM way w JOIN joint j ON j.g = w.g AND j.i = w.seam WHERE w.p = 8)
SELECT g, min(cost)::BIGINT AS cost, min_by(n, cost * 100 + n) AS n FROM whole GROUP BY 1""")
def closed_tours(spark, sf):
    """The cheapest closed way round each vector's loop of eight points, over arcs of one to three steps."""
    e = F.col("embedding")
    at = lambda i, c: F.floor(100 * e[2 * (i % 8) + c].cast("double")).cast("long")
    cross = lambda a, b, p: F.abs((at(b, 0) - at(a, 0)) * (at(p, 1) - at(a, 1)) - (at(b, 1) - at(a, 1)) * (at(p, 0) - at(a, 0)))
    arc = lambda i, n, cost, si, so: F.struct(F.lit(i).alias("start"), F.lit(n).alias("len"), cost.cast("long").alias("cost"), F.lit(si).alias("smooth_in"), F.lit(so).alias("smooth_out"))
    arcs = [arc(i, 1, F.lit(30), False, False) for i in range(8)]
    for i in range(8):
        for n in (2, 3):
            off = sum(F.floor(cross(i, i + n, i + k) / 50) for k in range(1, n))
            arcs += [arc(i, n, 34 + off, True, True), arc(i, n, 39 + off, False, True)]
    joints = [F.struct(F.floor(cross(i + 7, i, i + 1) / 100).alias("smooth"), F.lit(12).cast("long").alias("corner")) for i in range(8)]
    loops = table(spark, sf, "embeddings").select(F.col("vec_id").alias("g"), F.lit(8).alias("m"), F.array(*arcs).alias("arcs"), F.array(*joints).alias("joints"))
    return cheapest_tours(written(loops, "loops")).select("g", "cost", "n")
