"""Queries of trees, spatial joins and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import matching as M
from ..operators import raster as K
from ..operators import sequence as Q
from ..operators import spatial as D
from ..operators import tree as T
from ..sources.roles import LABELS, labels, table
from ..sources.scratch import written
from .registry import query


def nodes(spark, sf):
    """region, nation, customer and orders as one tree; every seventh customer is half transparent,
    and orders of status F are hidden."""
    one, yes = F.lit(1.0), F.lit(True)
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), one.alias("opacity"), yes.alias("visible"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), one.alias("opacity"), yes.alias("visible"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 7 == 0, 0.5).otherwise(1.0).alias("opacity"), yes.alias("visible"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.col("o_orderkey").alias("ord"), F.lit(0.5).alias("opacity"), (F.col("o_orderstatus") != "F").alias("visible"))
    return r.unionByName(n).unionByName(c).unionByName(o)


NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS BIGINT) AS ord, CAST(1.0 AS DOUBLE) AS opacity, true AS visible FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 1.0, true FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE 1.0 END, true FROM customer
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 0.5, o_orderstatus <> 'F' FROM orders),
walk AS (SELECT id, parent, 0 AS depth, opacity, visible FROM nodes WHERE parent IS NULL
 UNION ALL SELECT n.id, n.parent, w.depth + 1, w.opacity * n.opacity, w.visible AND n.visible FROM walk w JOIN nodes n ON n.parent = w.id)"""


@query(f"WITH RECURSIVE {NODES} SELECT id, depth, opacity, visible FROM walk")
def doc_walk(spark, sf):
    return T.walked(nodes(spark, sf), lambda df: written(df, "walk")).select("id", "depth", "opacity", "visible")


@query(f"WITH RECURSIVE {NODES} SELECT depth, count(*) AS leaves, count(*) FILTER (WHERE visible) AS shown, sum(opacity) AS ink FROM walk w WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.parent = w.id) GROUP BY depth")
def doc_leaves(spark, sf):
    w = T.walked(nodes(spark, sf), lambda df: written(df, "walk"))
    parents = nodes(spark, sf).select(F.col("parent").alias("id")).where("id is not null").distinct()
    return w.join(parents, "id", "left_anti").groupBy("depth").agg(F.count("*").alias("leaves"), F.count_if("visible").alias("shown"), F.sum("opacity").alias("ink"))


@query(f"""WITH RECURSIVE {NODES}, anc AS (SELECT id, id AS ancestor, 0 AS distance, parent FROM nodes
 UNION ALL SELECT a.id, n.id, a.distance + 1, n.parent FROM anc a JOIN nodes n ON n.id = a.parent)
SELECT ancestor, count(*) AS under, max(distance) AS deepest FROM anc WHERE distance > 0 GROUP BY ancestor""")
def doc_closure(spark, sf):
    a = T.ancestors(nodes(spark, sf), lambda df: written(df, "ancestors")).where("distance > 0")
    return a.groupBy("ancestor").agg(F.count("*").alias("under"), F.max("distance").alias("deepest"))


@query(f"""WITH RECURSIVE {NODES}, chosen AS (SELECT id, parent FROM nodes WHERE ord % 5 = 0),
anc AS (SELECT id AS top, id, parent FROM chosen UNION ALL SELECT a.top, n.id, n.parent FROM anc a JOIN nodes n ON n.id = a.parent)
SELECT id FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM anc a JOIN chosen d ON d.id = a.id WHERE a.top = c.id AND a.id <> c.id)""")
def top_level_selection(spark, sf):
    """Chosen nodes without those under another chosen node."""
    return T.top_level(nodes(spark, sf), F.col("ord") % 5 == 0, lambda df: written(df, "top-level"))


def _points(spark, sf, part: int):
    e = F.col("embedding")
    p = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == part)
    return p.select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


PTS = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"""WITH {PTS} SELECT id, oid, round(distance, 6) AS distance FROM (SELECT a.id, b.id AS oid, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance,
 row_number() OVER (PARTITION BY a.id ORDER BY round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 12), b.id) AS r FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1) WHERE r = 1""")
def nearest_grid(spark, sf):
    """Every even vector to the nearest odd one in the plane of two axes."""
    o = _points(spark, sf, 1).select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    n = D.nearest(_points(spark, sf, 0), o, 0.02, [], lambda df: written(df, "nearest"))
    return n.select("id", "oid", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PTS} SELECT DISTINCT a.id FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0001""")
def matched_corners(spark, sf):
    o = _points(spark, sf, 1).select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return D.matched(_points(spark, sf, 0), o, 0.01, [])


@query(f"""WITH RECURSIVE {PTS}, q AS (SELECT a.id, b.id AS oid FROM p a JOIN p b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0001),
w AS (SELECT id, id AS c FROM p UNION SELECT q.oid, w.c FROM w JOIN q ON q.id = w.id)
SELECT c AS cluster, count(*) AS members FROM (SELECT id, min(c) AS c FROM w GROUP BY id) GROUP BY c""")
def radius_clusters(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    o = p.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = D.within(p, o, 0.01, []).where("id < oid")
    c = D.linked_ids(pairs, p, lambda df: written(df, "clusters"))
    return c.groupBy("cluster").agg(F.count("*").alias("members"))


CROSSINGS = f"""WITH {PTS}, s AS (SELECT a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON b.id = a.id + 1),
o AS (SELECT a.id, b.id AS oid, sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * sign((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) AS s1,
 sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * sign((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) AS s2 FROM s a JOIN s b ON a.id < b.id)
SELECT id, oid FROM o WHERE s1 < 0 AND s2 < 0"""


@query(CROSSINGS, name="edge_crossings_whole")
@query(CROSSINGS)
def edge_crossings(spark, sf):
    """Crossings among the segments of all consecutive vectors."""
    return D.crossings(_segments(spark, sf), 0.1)


def _segments(spark, sf):
    """From each vector to the next, in the plane of their first two parts."""
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return p.join(b, "id").select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


@query("""WITH RECURSIVE q AS (SELECT s_suppkey AS id, c_custkey AS oid, round(abs(s_acctbal - c_acctbal), 2) AS gap FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 300)
SELECT s_suppkey AS id, min_gap FROM supplier JOIN (SELECT id, min(gap) AS min_gap FROM q GROUP BY id) ON s_suppkey = id""", name="caption_gaps")
def caption_gaps(spark, sf):
    """A supplier's least gap to a customer of its nation: those next to its value are enough."""
    s, c = _captions(spark, sf)
    near = D.with_beside(s, c, "g", "a", "b", 300)
    gap = lambda b: F.when(F.abs(F.col("a") - F.col(b)) <= 300, F.round(F.abs(F.col("a") - F.col(b)), 2))
    return near.select("id", F.least(gap("below"), gap("above")).alias("min_gap")).where("min_gap is not null").groupBy("id").agg(F.min("min_gap").alias("min_gap"))


def _captions(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("a"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("oid"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("b"))
    return s, c


@query("""WITH RECURSIVE q AS (SELECT s_suppkey AS id, c_custkey AS oid, round(abs(s_acctbal - c_acctbal), 2) AS gap FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 300),
o AS (SELECT id, oid, gap, row_number() OVER (ORDER BY gap, id, oid) AS place FROM q),
g AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS oids, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS oid, CAST(NULL AS DOUBLE) AS gap
 UNION ALL SELECT m.place, list_append(m.ids, o.id), list_append(m.oids, o.oid), o.id, o.oid, o.gap
 FROM (SELECT g.ids, g.oids, min(o.place) AS place FROM g JOIN o ON o.place > g.place AND NOT list_contains(g.ids, o.id) AND NOT list_contains(g.oids, o.oid) GROUP BY 1, 2) m JOIN o ON o.place = m.place)
SELECT id, oid, gap FROM g WHERE id IS NOT NULL""")
def match_captions(spark, sf):
    """Greedy one-to-one matching within a gap, by ascending gap."""
    return M.matched_on_line(*_captions(spark, sf), "g", "a", "b", 300, lambda df: written(df, "captions"))


CHAIN = """k AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i,
 CAST(epoch(o_orderdate) AS DOUBLE) / 86400 AS x, o_totalprice / 1000 AS y FROM orders)"""


def _chain(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("g", F.col("o_custkey"))
    x = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double") / 86400
    return o.select("g", F.row_number().over(w).alias("i"), x.alias("x"), (F.col("o_totalprice") / 1000).alias("y"))


@query(f"""WITH {CHAIN}, s AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS byy FROM k WINDOW w AS (PARTITION BY g ORDER BY i))
SELECT g, round(sum(abs(degrees(atan2(ax * byy - ay * bx, ax * bx + ay * byy)))), 4) AS turn, round(sum(sqrt(ax * ax + ay * ay)), 4) AS length FROM s GROUP BY g""")
def polyline_turns(spark, sf):
    t = Q.turns(_chain(spark, sf), ["g"], "i")
    return t.groupBy("g").agg(F.round(F.sum("turn"), 4).alias("turn"), F.round(F.sum("length"), 4).alias("length"))


@query(f"""WITH {CHAIN}, s1 AS (SELECT g, i, coalesce((lag(y) OVER w + 2 * y + lead(y) OVER w) / 4, y) AS y FROM k WINDOW w AS (PARTITION BY g ORDER BY i)),
s2 AS (SELECT g, i, coalesce((lag(y) OVER w + 2 * y + lead(y) OVER w) / 4, y) AS y FROM s1 WINDOW w AS (PARTITION BY g ORDER BY i)) SELECT g, i, round(y, 6) AS y FROM s2""")
def box_smooth(spark, sf):
    return Q.box_smooth(_chain(spark, sf), ["g"], "i", "y", 2).select("g", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(f"""WITH {CHAIN}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WINDOW w AS (PARTITION BY g ORDER BY i)),
l AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM e WHERE nx IS NOT NULL),
c AS (SELECT *, sum(len) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS done FROM l),
b AS (SELECT *, done - len AS before FROM c WHERE len > 0),
r AS (SELECT *, unnest(range(CAST(ceil(round(before / 500, 9)) AS BIGINT), CAST(ceil(round(done / 500, 9)) AS BIGINT))) AS n FROM b)
SELECT g, n AS k, round(x + (n * 500 - before) / len * (nx - x), 6) AS x, round(y + (n * 500 - before) / len * (ny - y), 6) AS y FROM r""")
def arc_resample(spark, sf):
    r = Q.resampled(_chain(spark, sf), ["g"], "i", 500.0)
    return r.select("g", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {CHAIN} SELECT g, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM k GROUP BY g HAVING count(*) > 2 AND var_pop(x) > 0""")
def line_fit(spark, sf):
    c = _chain(spark, sf).groupBy("g").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.var_pop("x").alias("v")
    )
    return c.where("n > 2 and v > 0").select("g", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(f"""WITH {LABELS}, o AS (SELECT img_id, x, y, CASE WHEN label >= 2 THEN 1 ELSE 0 END AS ink FROM labels_px)
SELECT a.img_id, a.x, a.y, round(sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS d FROM o a JOIN o b ON a.img_id = b.img_id AND b.ink = 0 AND a.ink = 1 GROUP BY 1, 2, 3""")
def distance_transform(spark, sf):
    px = labels(spark, sf).withColumn("ink", (F.col("label") >= 2).cast("int"))
    return G.distance_transform(px).select("img_id", "x", "y", F.round("d", 6).alias("d"))


@query()
def thinned(spark, sf):
    """Skeleton pixels of each image's ink."""
    px = labels(spark, sf).withColumn("ink", (F.col("label") >= 1).cast("int"))
    return G.thinned(px)


@query()
def traced_regions(spark, sf):
    """Each image's regions as outlines: boundary network, chained loops, simplified, as path text."""
    return G.traced(labels(spark, sf))


@query()
def fitted_curves(spark, sf):
    """One cubic for each customer's chain of orders, and how far it strays."""
    return G.fitted_cubics(_chain(spark, sf))


@query(f"""WITH {LABELS}, m AS (SELECT img_id, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy, avg(x * v) AS xv, avg(y * v) AS yv FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
c AS (SELECT *, xx - mx * mx AS sxx, yy - my * my AS syy, xy - mx * my AS sxy, xv - mx * mv AS sxv, yv - my * mv AS syv FROM m)
SELECT img_id, label, n, round((sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy), 5) AS gx, round((syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy), 5) AS gy FROM c WHERE n >= 6 AND sxx * syy - sxy * sxy > 1e-6""")
def plane_fit(spark, sf):
    """Gradient of the level over each region, by moments and a two by two solve."""
    return G.plane_fit(labels(spark, sf)).select("img_id", "label", "n", F.round("gx", 5).alias("gx"), F.round("gy", 5).alias("gy"))


@query(f"""WITH {LABELS}, s AS (SELECT a.img_id, a.label, b.label AS other, count(*) AS shared FROM labels_px a JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.label <> b.label WHERE b.label >= 0 GROUP BY 1, 2, 3),
z AS (SELECT img_id, label, count(*) AS n FROM labels_px WHERE label >= 0 GROUP BY 1, 2)
SELECT z.img_id, z.label, CAST(coalesce(CASE WHEN n < 8 THEN s.other END, z.label) AS INTEGER) AS merged FROM z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY img_id, label ORDER BY shared DESC, other) AS r FROM s) s ON s.img_id = z.img_id AND s.label = z.label AND s.r = 1""")
def drop_minor_labels(spark, sf):
    """Labels with few pixels dissolve into the neighbour they share most boundary with."""
    px = K.with_cross(labels(spark, sf), "label")
    near = px.select("img_id", "label", F.explode(F.array("l", "r", "u", "d")).alias("other")).where("other >= 0 and other <> label and label >= 0")
    shared = near.groupBy("img_id", "label", "other").agg(F.count("*").alias("shared"))
    best = shared.groupBy("img_id", "label").agg(F.max(F.struct(F.col("shared"), (-F.col("other")).alias("low"))).alias("b"))
    z = px.where("label >= 0").groupBy("img_id", "label").agg(F.count("*").alias("n"))
    merged = F.coalesce(F.when(F.col("n") < 8, -F.col("b.low")), F.col("label"))
    return z.join(best, ["img_id", "label"], "left").select("img_id", "label", merged.cast("int").alias("merged"))
