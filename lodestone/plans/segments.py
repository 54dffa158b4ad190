"""Queries of segmentation steps, colour and path expressions, manifests and schema shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import geometry as G
from ..operators import raster as K
from ..operators import segment as E
from ..sources.roles import LABELS, PIXELS, labels, pixels, table
from ..sources.scratch import written
from .registry import query

STEPS = """st AS (SELECT p.img_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, abs(p.v - q.v) AS step FROM labels_px p JOIN labels_px q
 ON p.img_id = q.img_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.y = p.y + 1 AND q.x = p.x)) AND p.label <> q.label WHERE least(p.label, q.label) >= 0),
mn AS (SELECT img_id, label, avg(v) AS m FROM labels_px WHERE label >= 0 GROUP BY 1, 2)"""


@query(f"""WITH {LABELS}, {STEPS} SELECT st.img_id, st.a, st.b, count(*) AS steps, avg(CAST(step >= abs(p.m - q.m) / 2 AS INTEGER)) <= 0.25 AS soft FROM st
 JOIN mn p ON p.img_id = st.img_id AND p.label = st.a JOIN mn q ON q.img_id = st.img_id AND q.label = st.b GROUP BY 1, 2, 3""")
def soft_pairs(spark, sf):
    return E.soft_pairs(labels(spark, sf)).select("img_id", "a", "b", "steps", "soft")


@query(f"""WITH {LABELS}, {STEPS} SELECT st.img_id, st.a, st.b, count(*) AS length, round(max(abs(p.m - q.m)), 6) AS contrast FROM st
 JOIN mn p ON p.img_id = st.img_id AND p.label = st.a JOIN mn q ON q.img_id = st.img_id AND q.label = st.b GROUP BY 1, 2, 3""")
def edge_contrast(spark, sf):
    """Difference of the mean levels on the two sides of each boundary, and its length."""
    px = labels(spark, sf)
    means = px.where("label >= 0").groupBy("img_id", "label").agg(F.avg("v").alias("m"))
    n = E.boundary_steps(px).groupBy("img_id", "a", "b").agg(F.count("*").alias("length"))
    a = means.select("img_id", F.col("label").alias("a"), F.col("m").alias("ma"))
    b = means.select("img_id", F.col("label").alias("b"), F.col("m").alias("mb"))
    return n.join(a, ["img_id", "a"]).join(b, ["img_id", "b"]).select("img_id", "a", "b", "length", F.round(F.abs(F.col("ma") - F.col("mb")), 6).alias("contrast"))


@query(f"""WITH {LABELS}, n AS (SELECT img_id, label, v, count(*) AS n FROM labels_px WHERE label >= 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY img_id, label ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY img_id, label) AS a FROM n)
SELECT img_id, label, v AS mode, round(n * 1.0 / a, 9) AS share FROM r WHERE r = 1""")
def region_modes(spark, sf):
    """The most frequent level of each label, the lowest of several, and its share."""
    n = labels(spark, sf).where("label >= 0").groupBy("img_id", "label", "v").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("v")).alias("low")))
    m = n.groupBy("img_id", "label").agg(best.alias("b"), F.sum("n").alias("a"))
    return m.select("img_id", "label", (-F.col("b.low")).cast("int").alias("mode"), F.round(F.col("b.n") / F.col("a"), 9).alias("share"))


@query(f"""WITH RECURSIVE {LABELS}, walk AS (SELECT img_id, x, y, label, y * 65536 + x AS comp FROM labels_px
 UNION SELECT b.img_id, b.x, b.y, b.label, w.comp FROM walk w JOIN labels_px b ON b.img_id = w.img_id AND b.label = w.label AND abs(b.x - w.x) + abs(b.y - w.y) = 1),
c AS (SELECT img_id, x, y, label, min(comp) AS comp FROM walk GROUP BY 1, 2, 3, 4), z AS (SELECT img_id, comp, count(*) AS area FROM c GROUP BY 1, 2),
v AS (SELECT a.img_id, a.comp, b.label AS o, count(*) AS n FROM c a JOIN c b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.label <> b.label GROUP BY 1, 2, 3),
t AS (SELECT img_id, comp, o, row_number() OVER (PARTITION BY img_id, comp ORDER BY n DESC, o) AS r FROM v)
SELECT c.img_id, c.x, c.y, CAST(CASE WHEN z.area < 3 THEN coalesce(t.o, c.label) ELSE c.label END AS INTEGER) AS label FROM c JOIN z ON z.img_id = c.img_id AND z.comp = c.comp
 LEFT JOIN t ON t.img_id = c.img_id AND t.comp = c.comp AND t.r = 1""")
def despeckle_components(spark, sf):
    px = labels(spark, sf).select("img_id", "x", "y", "label")
    return E.despeckled(px, K.components(px, False, lambda df: written(df, "despeckle")), 3)


@query(f"""WITH {LABELS}, n AS (SELECT img_id, label, count(*) AS n FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS r FROM n) SELECT img_id, round(1 - sum(n) FILTER (WHERE r <= 2) / sum(n), 9) AS third FROM t GROUP BY 1""")
def third_colour_share(spark, sf):
    """Share of opaque pixels outside the two most frequent labels."""
    n = labels(spark, sf).where("label >= 0").groupBy("img_id", "label").agg(F.count("*").alias("n"))
    t = n.withColumn("r", F.row_number().over(Window.partitionBy("img_id").orderBy(F.col("n").desc(), "label")))
    return t.groupBy("img_id").agg(F.round(1 - F.sum(F.when(F.col("r") <= 2, F.col("n"))) / F.sum("n"), 9).alias("third"))


@query(f"""WITH {PIXELS}, g AS (SELECT i.img_id, gx AS x, gy AS y FROM (SELECT DISTINCT img_id FROM pixels) i, (SELECT unnest(range(0, 15)) AS gx) a, (SELECT unnest(range(0, 15)) AS gy) b)
SELECT g.img_id, g.x, g.y, round(avg(p.v), 6) AS v FROM g JOIN pixels p ON p.img_id = g.img_id AND p.x IN (CAST(floor(g.x / 2) AS INTEGER), CAST(ceil(g.x / 2.0) AS INTEGER)) AND p.y IN (CAST(floor(g.y / 2) AS INTEGER), CAST(ceil(g.y / 2.0) AS INTEGER)) GROUP BY 1, 2, 3""")
def upscale(spark, sf):
    """Twice the resolution between pixel centres, bilinear: each pixel adds to the places around it."""
    near = lambda c: F.array(2 * F.col(c) - 1, 2 * F.col(c), 2 * F.col(c) + 1)
    p = pixels(spark, sf).withColumn("nx", F.explode(near("x"))).withColumn("ny", F.explode(near("y")))
    p = p.where("nx between 0 and 14 and ny between 0 and 14")
    return p.groupBy("img_id", F.col("nx").cast("long").alias("x"), F.col("ny").cast("long").alias("y")).agg(F.round(F.avg("v"), 6).alias("v"))


@query(f"""WITH {PIXELS} SELECT img_id, x, y, '#' || lower(lpad(printf('%x', v), 2, '0')) || lower(lpad(printf('%x', 255 - v), 2, '0')) || '10' AS hex,
 CASE WHEN v >= 128 THEN 'light' ELSE 'dark' END AS side FROM pixels""")
def hex_color(spark, sf):
    v = F.col("v")
    return pixels(spark, sf).select("img_id", "x", "y", X.channels_to_hex(v, 255 - v, F.lit(16)).alias("hex"), F.when(v >= 128, "light").otherwise("dark").alias("side"))


@query(f"""WITH {PIXELS}, s AS (SELECT img_id, list(v ORDER BY y, x) AS p FROM pixels WHERE y = 3 GROUP BY 1), c AS (SELECT img_id, p, unnest(range(0, 5)) AS k FROM s)
SELECT img_id, k, round(pow(1 - k / 4.0, 3) * p[1] + 3 * pow(1 - k / 4.0, 2) * (k / 4.0) * p[3] + 3 * (1 - k / 4.0) * pow(k / 4.0, 2) * p[6] + pow(k / 4.0, 3) * p[8], 6) AS b FROM c""")
def cubic_points(spark, sf):
    """A row of each image as the heights of a cubic's four controls, at five parameters."""
    s = pixels(spark, sf).where("y = 3").groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("p"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    t = F.col("k") / 4.0
    c = [F.col("p")[i]["v"] for i in (0, 2, 5, 7)]
    b = F.pow(1 - t, F.lit(3)) * c[0] + 3 * F.pow(1 - t, F.lit(2)) * t * c[1] + 3 * (1 - t) * F.pow(t, F.lit(2)) * c[2] + F.pow(t, F.lit(3)) * c[3]
    return s.select("img_id", "k", F.round(b, 6).alias("b"))


@query("""SELECT p_brand AS name, '{"name":"' || p_brand || '","icons":[' || string_agg('{"src":"' || p_partkey || '.png","sizes":"' || p_size || 'x' || p_size || '"}', ',' ORDER BY p_partkey) || ']}' AS manifest FROM part GROUP BY 1""")
def build_manifest(spark, sf):
    """A manifest for each brand: its parts as icons, in order."""
    icon = F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("src"), F.concat_ws("x", F.col("p_size").cast("string"), F.col("p_size").cast("string")).alias("sizes"))
    icons = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", icon.alias("i")))), lambda s: s["i"])
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(icons.alias("icons"))
    return p.select("name", F.to_json(F.struct("name", "icons")).alias("manifest"))


FLAT_ROWS = """SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS VARCHAR) AS amount, NULL AS size, NULL AS segment FROM orders
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), NULL, CAST(p_size AS BIGINT), NULL FROM part UNION ALL SELECT 'customer', c_name, CAST(c_custkey AS VARCHAR), NULL, c_mktsegment FROM customer"""


@query(FLAT_ROWS, name="flatten_schema_whole")
@query(FLAT_ROWS)
def flatten_schema(spark, sf):
    """Rows of three kinds under one schema: columns by name, missing ones null, mixed types as text."""
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("amount"))
    p = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("long").alias("size"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("id"), F.col("c_custkey").cast("string").alias("amount"), F.col("c_mktsegment").alias("segment"))
    return o.unionByName(p, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer s WHERE s.c_custkey % 50 = 0 AND s.c_nationkey = c.c_nationkey AND s.c_mktsegment = c.c_mktsegment)""")
def select_same(spark, sf):
    """Items whose paint (nation and segment) equals a chosen item's."""
    c = table(spark, sf, "customer")
    chosen = c.where("c_custkey % 50 = 0").select("c_nationkey", "c_mktsegment").distinct()
    return c.join(chosen, ["c_nationkey", "c_mktsegment"], "left_semi").select("c_custkey")


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT conv_id, role, n, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, role, n ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT conv_id, count(DISTINCT run) AS runs, CAST(sum(n) AS BIGINT) AS chars, count(*) AS turns FROM r GROUP BY 1""")
def conversation_runs(spark, sf):
    """Adjacent turns of one role as one run."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf, "conversations").select("conv_id", F.length("text").alias("n"), F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1).alias("new"))
    return t.groupBy("conv_id").agg(F.sum("new").alias("runs"), F.sum("n").alias("chars"), F.count("*").alias("turns"))


@query()
def skeleton_graph(spark, sf):
    """Ends and joints of each image's skeleton."""
    thin = written(G.thinned(labels(spark, sf).withColumn("ink", (F.col("label") >= 1).cast("int"))), "skeleton")
    d = E.skeleton_degrees(thin)
    return d.groupBy("img_id").agg(F.count_if(F.col("degree") == 1).alias("ends"), F.count_if(F.col("degree") >= 3).alias("joints"), F.count("*").alias("pixels"))


@query()
def step_smoothing(spark, sf):
    s = E.smoothed(pixels(spark, sf))
    return s.groupBy("img_id").agg(F.round(F.avg("u"), 6).alias("mean"), F.round(F.stddev_pop("u"), 6).alias("spread"))


def _palette_sql(k: int, rounds: int) -> str:
    parts = [
        f"WITH {PIXELS}, h AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY v) - n / 2.0 AS share, sum(n) OVER (PARTITION BY img_id) AS a FROM (SELECT img_id, v, count(*) AS n FROM pixels GROUP BY 1, 2))",
        f"""c0 AS (SELECT DISTINCT img_id, CAST(c AS DOUBLE) AS c FROM (SELECT i.img_id, p, coalesce(min(h.v), max(i.top)) AS c FROM (SELECT img_id, max(v) AS top, max(a) AS a FROM h GROUP BY 1) i CROSS JOIN (SELECT (unnest(range(0, {k})) + 0.5) / {k} AS p) q
 LEFT JOIN h ON h.img_id = i.img_id AND h.share / h.a >= p GROUP BY 1, 2))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT * FROM (SELECT h.img_id, h.v, h.n, c, row_number() OVER (PARTITION BY h.img_id, h.v ORDER BY abs(h.v - c), c) AS r FROM h JOIN c{i} USING (img_id)) WHERE r = 1)")
        parts.append(f"c{i + 1} AS (SELECT img_id, CAST(sum(n * v) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS c FROM a{i} GROUP BY img_id, a{i}.c)")
    return ", ".join(parts) + f" SELECT img_id, row_number() OVER (PARTITION BY img_id ORDER BY sum(n) DESC, c) - 1 AS entry, c AS level, CAST(sum(n) AS BIGINT) AS count FROM a{rounds} GROUP BY img_id, c"


@query(_palette_sql(4, 6))
def quantize_palette(spark, sf):
    return E.weighted_palette(pixels(spark, sf), 4, 6)
