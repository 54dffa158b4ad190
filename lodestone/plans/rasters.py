"""Queries of the raster kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import raster as K
from ..operators.cluster import assign_nearest, lloyd
from ..sources.roles import LABELS, PIXELS, labels, pixels, table
from ..sources.scratch import written
from .registry import query


@query(f"WITH {LABELS} SELECT img_id, label, count(*) AS n FROM labels_px GROUP BY 1, 2")
def palette_hist(spark, sf):
    return K.palette(labels(spark, sf), ["label"]).withColumnRenamed("count", "n")


@query(f"""WITH {LABELS}, b AS (SELECT a.img_id, a.label, a.x, a.y, count(*) AS n, count(DISTINCT b.label) AS kinds FROM labels_px a
 JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4)
SELECT img_id, label, count(*) FILTER (WHERE n = 9 AND kinds = 1) AS flat, count(*) AS n FROM b GROUP BY 1, 2""")
def flat_interior(spark, sf):
    return K.flat_interior(labels(spark, sf)).withColumnRenamed("count", "n")


@query(f"""WITH {LABELS}, b AS (SELECT a.img_id, a.label, a.x, a.y, bool_or(a.label <> b.label) AS differs FROM labels_px a
 JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 WHERE a.label >= 0 GROUP BY 1, 2, 3, 4)
SELECT img_id, label, round(avg(CAST(differs AS INTEGER)), 9) AS share FROM b GROUP BY 1, 2""")
def edge_fraction(spark, sf):
    return K.edge_share(labels(spark, sf)).select("img_id", "label", F.round("share", 9).alias("share"))


@query(f"""WITH {LABELS}, r AS (SELECT img_id, label, count(*) AS n FROM labels_px WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY 1, 2),
o AS (SELECT img_id, sum(n) FILTER (WHERE label >= 0) AS o, sum(n) AS a FROM r GROUP BY 1),
t AS (SELECT img_id, label, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS p FROM r WHERE label >= 0)
SELECT o.img_id, CAST(CASE WHEN coalesce(o.o, 0) >= o.a / 2.0 THEN t.label ELSE -1 END AS INTEGER) AS background FROM o LEFT JOIN t ON o.img_id = t.img_id AND t.p = 1""")
def border_background(spark, sf):
    return K.border_background(labels(spark, sf), 8).select("img_id", F.col("background").cast("int").alias("background"))


@query(f"""WITH {LABELS}, n AS (SELECT a.img_id, a.x, a.y, a.label AS own, b.label, count(*) AS n FROM labels_px a
 JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4, 5)
SELECT img_id, x, y, label FROM (SELECT *, row_number() OVER (PARTITION BY img_id, x, y ORDER BY n DESC, (label = own) DESC, label) AS p FROM n) WHERE p = 1""")
def mode_filter_3x3(spark, sf):
    return K.mode_filter(labels(spark, sf)).select("img_id", "x", "y", "label")


@query(f"""WITH {PIXELS}, h AS (SELECT a.img_id, a.x, a.y, avg(b.v) AS m FROM pixels a JOIN pixels b ON a.img_id = b.img_id AND a.y = b.y AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3)
SELECT a.img_id, a.x, a.y, round(avg(b.m), 6) AS blur FROM h a JOIN h b ON a.img_id = b.img_id AND a.x = b.x AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3""")
def box_blur(spark, sf):
    return K.box_blur(pixels(spark, sf), "v", 1).select("img_id", "x", "y", F.round("blur", 6).alias("blur"))


@query(f"""WITH {PIXELS} SELECT a.img_id, a.x, a.y, max(b.v) AS grown, min(b.v) AS shrunk FROM pixels a
 JOIN pixels b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3""")
def dilate_3x3(spark, sf):
    grown = K.dilate(pixels(spark, sf), "v", 1).withColumnRenamed("out", "grown")
    return K.dilate(grown, "v", 1, erode=True).select("img_id", "x", "y", "grown", F.col("out").alias("shrunk"))


@query(f"""WITH {PIXELS} SELECT a.img_id, count(*) FILTER (WHERE e) AS edges, min(a.x) FILTER (WHERE a.v >= 128) AS x0, max(a.x) FILTER (WHERE a.v >= 128) AS x1 FROM
 (SELECT a.img_id, a.x, a.y, a.v, max(abs(a.v - b.v)) >= 64 AS e FROM pixels a JOIN pixels b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4) a GROUP BY 1""")
def edge_mask_bounds(spark, sf):
    """Edge pixels, and the bounds of the opaque ones."""
    on = F.when(F.col("v") >= 128, F.col("x"))
    return K.edge_mask(pixels(spark, sf), "v", 64).groupBy("img_id").agg(F.count_if(F.col("edge")).alias("edges"), F.min(on).alias("x0"), F.max(on).alias("x1"))


CRACKS = (
    LABELS
    + """, g AS (SELECT i.img_id, gx AS x, gy AS y, coalesce(l.label, -1) AS label FROM (SELECT DISTINCT img_id FROM labels_px) i, (SELECT unnest(range(-1, 9)) AS gx) p, (SELECT unnest(range(-1, 9)) AS gy) q
 LEFT JOIN labels_px l ON l.img_id = i.img_id AND l.x = gx AND l.y = gy),
cr AS (SELECT b.img_id, b.x AS x0, b.y AS y0, b.x AS x1, b.y + 1 AS y1, a.label AS a, b.label AS b FROM g a JOIN g b ON a.img_id = b.img_id AND a.y = b.y AND b.x = a.x + 1 WHERE a.label <> b.label
 UNION ALL SELECT b.img_id, b.x, b.y, b.x + 1, b.y, a.label, b.label FROM g a JOIN g b ON a.img_id = b.img_id AND a.x = b.x AND b.y = a.y + 1 WHERE a.label <> b.label)"""
)


@query(f"WITH {CRACKS} SELECT img_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS steps FROM cr GROUP BY 1, 2, 3")
def crack_edges(spark, sf):
    c = K.cracks(labels(spark, sf))
    return c.groupBy("img_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("steps"))


@query(f"""WITH {CRACKS}, e AS (SELECT img_id, x0 AS x, y0 AS y FROM cr UNION ALL SELECT img_id, x1, y1 FROM cr)
SELECT img_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS degree FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def junction_degree(spark, sf):
    return K.junctions(K.cracks(labels(spark, sf))).select("img_id", F.col("x").cast("long"), F.col("y").cast("long"), "degree")


@query(f"""WITH {PIXELS} SELECT img_id, CAST(floor(x / 2) AS INTEGER) AS x, CAST(floor(y / 2) AS INTEGER) AS y, round(avg(v), 6) AS v FROM pixels GROUP BY 1, 2, 3""")
def downscale(spark, sf):
    return K.downscale(pixels(spark, sf), "v", 2).select("img_id", "x", "y", F.round("v", 6).alias("v"))


@query(f"""WITH {PIXELS}, s AS (SELECT a.img_id, abs(b.v - a.v) AS s FROM pixels a JOIN pixels b ON a.img_id = b.img_id AND a.y = b.y AND b.x = a.x + 1)
SELECT img_id, count(*) FILTER (WHERE s < 8) AS flat, count(*) FILTER (WHERE s >= 8 AND s < 48) AS ramp, count(*) FILTER (WHERE s >= 48) AS edge FROM s GROUP BY 1""")
def rampiness(spark, sf):
    return K.rampiness(pixels(spark, sf), "v", 8, 48)


SSIM_SQL = f"""WITH {PIXELS}, b AS (SELECT a.img_id, a.x, a.y, CAST(a.v AS DOUBLE) AS a, CAST(b.v AS DOUBLE) AS b FROM pixels a JOIN pixels b ON b.img_id = a.img_id + 1 AND a.x = b.x AND a.y = b.y),
w AS (SELECT p.img_id, p.x, p.y, count(*) AS n, avg(q.a) AS ma, avg(q.b) AS mb, avg(q.a * q.a) AS aa, avg(q.b * q.b) AS bb, avg(q.a * q.b) AS ab FROM b p
 JOIN b q ON p.img_id = q.img_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 GROUP BY 1, 2, 3)
SELECT img_id, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) AS ssim FROM w WHERE n = 9 GROUP BY 1"""


@query(SSIM_SQL)
def ssim_window(spark, sf):
    """Each image against the one after it."""
    px = pixels(spark, sf)
    return K.ssim(px, px.withColumn("img_id", F.col("img_id") - 1), 1).select("img_id", F.round("ssim", 6).alias("ssim"))


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


def _lab_f(t: str) -> str:
    return f"CASE WHEN {t} > 216.0 / 24389 THEN pow({t}, 1.0 / 3) ELSE (24389.0 / 27 * {t} + 16) / 116 END"


DELTA = f"""WITH {PIXELS}, l AS (SELECT img_id, x, y, {_lin('v')} AS r, {_lin('(255 - v)')} AS g, {_lin('CAST(floor(v / 2) AS INTEGER)')} AS b FROM pixels),
z AS (SELECT img_id, x, y, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS tx, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS ty, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS tz FROM l),
f AS (SELECT img_id, x, y, {_lab_f('tx')} AS fx, {_lab_f('ty')} AS fy, {_lab_f('tz')} AS fz FROM z),
d AS (SELECT a.img_id, sqrt(pow(116 * (a.fy - b.fy), 2) + pow(500 * ((a.fx - a.fy) - (b.fx - b.fy)), 2) + pow(200 * ((a.fy - a.fz) - (b.fy - b.fz)), 2)) AS de
 FROM f a JOIN f b ON b.img_id = a.img_id + 1 AND a.x = b.x AND a.y = b.y)
SELECT img_id, round(avg(de), 4) AS mean_de, round(list_sort(list(de))[CAST(floor(0.95 * 63) AS INTEGER) + 1], 4) AS p95_de FROM d GROUP BY 1"""


@query(DELTA)
def delta_e(spark, sf):
    """Colour difference of each image, tinted by its level, to the one after it."""
    v = F.col("v")
    tint = pixels(spark, sf).select("img_id", "x", "y", *[c.alias(n) for c, n in zip(X.lab(v, 255 - v, F.floor(v / 2)), "Lab", strict=True)])
    other = tint.select((F.col("img_id") - 1).alias("img_id"), "x", "y", *[F.col(n).alias(f"{n}2") for n in "Lab"])
    de = X.distance(tuple(F.col(n) for n in "Lab"), tuple(F.col(f"{n}2") for n in "Lab"))
    d = tint.join(other, ["img_id", "x", "y"]).select("img_id", de.alias("de"))
    # an image has 64 pixels: its differences are put in order as they stand
    ordered = F.sort_array(F.collect_list("de"))
    p95 = F.element_at(ordered, (F.floor(F.round(0.95 * (F.count("*") - 1), 9)) + 1).cast("int"))
    return d.groupBy("img_id").agg(F.round(F.avg("de"), 4).alias("mean_de"), F.round(p95, 4).alias("p95_de"))


def _components_sql(near: str) -> str:
    return f"""WITH RECURSIVE {LABELS}, walk AS (SELECT img_id, x, y, label, y * 65536 + x AS comp FROM labels_px
 UNION SELECT b.img_id, b.x, b.y, b.label, w.comp FROM walk w JOIN labels_px b ON b.img_id = w.img_id AND b.label = w.label AND {near}),
c AS (SELECT img_id, x, y, label, min(comp) AS comp FROM walk GROUP BY 1, 2, 3, 4)
SELECT img_id, CAST(comp AS BIGINT) AS comp, label, count(*) AS area, min(x) AS x0, max(x) AS x1 FROM c GROUP BY 1, 2, 3"""


def _components(spark, sf, eight: bool):
    c = K.components(labels(spark, sf).select("img_id", "x", "y", "label"), eight, lambda df: written(df, "components"))
    return c.groupBy("img_id", "comp", "label").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query(_components_sql("abs(b.x - w.x) + abs(b.y - w.y) = 1"))
def components_4(spark, sf):
    return _components(spark, sf, False)


@query(_components_sql("greatest(abs(b.x - w.x), abs(b.y - w.y)) = 1"))
def components_8(spark, sf):
    return _components(spark, sf, True)


def _points(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), *[e[i].cast("double").alias(f"p{i}") for i in range(3)])


POINTS = "pts AS (SELECT vec_id AS id, label AS truth, CAST(embedding[1] AS DOUBLE) AS p0, CAST(embedding[2] AS DOUBLE) AS p1, CAST(embedding[3] AS DOUBLE) AS p2 FROM embeddings)"


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [f"WITH {POINTS}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, p0, p1, p2 FROM pts ORDER BY id LIMIT {k})"]
    for i in range(rounds):
        parts.append(
            f"""a{i} AS (SELECT id, truth, p0, p1, p2, c FROM (SELECT p.*, c.c, row_number() OVER (PARTITION BY id ORDER BY round(pow(p.p0 - c.p0, 2) + pow(p.p1 - c.p1, 2) + pow(p.p2 - c.p2, 2), 12), c.c) AS r FROM pts p, c{i} c) WHERE r = 1),
c{i + 1} AS (SELECT c, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM a{i} GROUP BY c)"""
        )
    return ", ".join(parts) + f" SELECT a.c, count(*) AS n, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2 FROM a{rounds - 1} a GROUP BY a.c"


@query(_lloyd_sql(8, 4))
def kmeans_lloyd_k(spark, sf):
    a = lloyd(_points(spark, sf), ["p0", "p1", "p2"], 8, 4)
    return a.groupBy("c").agg(F.count("*").alias("n"), *[F.round(F.avg(p), 6).alias(p) for p in ("p0", "p1", "p2")])


@query(f"""WITH {POINTS}, t AS (SELECT truth, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM pts GROUP BY truth)
SELECT id, near FROM (SELECT p.id, t.truth AS near, row_number() OVER (PARTITION BY p.id ORDER BY round(pow(p.p0 - t.p0, 2) + pow(p.p1 - t.p1, 2) + pow(p.p2 - t.p2, 2), 12), t.truth) AS r FROM pts p, t) WHERE r = 1""")
def assign_locked(spark, sf):
    """Each point to the nearest entry of a locked palette: the mean of each true label."""
    p = _points(spark, sf)
    entries = p.groupBy(F.col("truth").alias("c")).agg(*[F.avg(x).alias(x) for x in ("p0", "p1", "p2")])
    return assign_nearest(p, entries, ["p0", "p1", "p2"]).select("id", F.col("c").alias("near"))
