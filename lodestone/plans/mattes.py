"""Queries of mattes, compositing, restored floods and label steps of a segmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import matte as M
from ..operators import raster as K
from ..sources.roles import LABELS, PIXELS, labels, pixels
from ..sources.scratch import written
from .registry import query

# a pixel's level is its opacity, its complement the colour
INK = "(255 - v)"


@query(f"""WITH {PIXELS} SELECT img_id, x, y, CAST(floor({INK} * (v / 255.0::DOUBLE) + 40 * (1 - v / 255.0::DOUBLE) + 0.5) AS INTEGER) AS flat,
 CAST(round_even({INK} * v / 255.0::DOUBLE + 255 * (1 - v / 255.0::DOUBLE), 0) AS INTEGER) AS over_white, CASE WHEN v = 0 THEN {INK} ELSE 18 END AS recoloured FROM pixels""")
def composites(spark, sf):
    """Each pixel laid on a colour (halves round up), on white (halves round to even), and recoloured
    where it is not clear."""
    a = F.col("v") / 255.0
    ink = 255 - F.col("v")
    return pixels(spark, sf).select(
        "img_id", "x", "y",
        F.floor(ink * a + 40 * (1 - a) + 0.5).cast("int").alias("flat"),
        F.bround(ink * F.col("v") / 255.0 + 255 * (1 - a)).cast("int").alias("over_white"),
        F.when(F.col("v") == 0, ink).otherwise(18).alias("recoloured"),
    )


@query(f"""WITH {PIXELS} SELECT a.img_id, a.x, a.y, min(b.v) AS v FROM pixels a JOIN pixels b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY 1, 2, 3""")
def shrink_matte(spark, sf):
    return K.dilate(pixels(spark, sf), "v", 1, erode=True).select("img_id", "x", "y", F.col("out").alias("v"))


@query(f"""WITH {PIXELS}, n AS (SELECT a.img_id, a.x, a.y, a.v, 255 - a.v AS ink, sum(255 - b.v) FILTER (WHERE b.v >= 200) AS s, count(*) FILTER (WHERE b.v >= 200) AS n FROM pixels a JOIN pixels b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 3 AND abs(b.y - a.y) <= 3 GROUP BY 1, 2, 3, 4)
SELECT img_id, x, y, CAST(CASE WHEN v = 0 OR v >= 200 THEN ink WHEN n > 0 THEN floor(s / n::DOUBLE + 0.5) ELSE floor(ink - (60 - ink) * (1 - v / 255.0::DOUBLE) + 0.5) END AS INTEGER) AS ink FROM n""")
def defringe(spark, sf):
    """Half-clear pixels take the mean colour of the solid ones within three pixels; where there are
    none their colour moves away from the key. Sums over rows, then over columns."""
    ink, v = 255 - F.col("v"), F.col("v")
    px = pixels(spark, sf).withColumns({"ink": ink, "s": F.when(v >= 200, ink).otherwise(0), "n": (v >= 200).cast("int")})
    for w in (K.row(), K.column()):
        px = px.withColumns({c: F.sum(c).over(w.rowsBetween(-3, 3)) for c in ("s", "n")})
    away = F.col("ink") - (60 - F.col("ink")) * (1 - v / 255.0)
    new = F.when((v == 0) | (v >= 200), F.col("ink")).when(F.col("n") > 0, F.floor(F.col("s") / F.col("n") + 0.5)).otherwise(F.floor(away + 0.5))
    return px.select("img_id", "x", "y", new.cast("int").alias("ink"))


CORNERS = "k AS (SELECT img_id, floor(avg(v) + 0.5) AS key FROM pixels WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY 1)"


@query(f"""WITH RECURSIVE {PIXELS}, {CORNERS}, p AS (SELECT p.*, abs(v - key) < 60 AS near FROM pixels p JOIN k ON k.img_id = p.img_id),
f AS (SELECT img_id, x, y FROM p WHERE near AND x IN (0, 7) AND y IN (0, 7) UNION SELECT p.img_id, p.x, p.y FROM f JOIN p ON p.img_id = f.img_id AND p.near AND abs(p.x - f.x) + abs(p.y - f.y) = 1)
SELECT p.img_id, count(f.img_id) AS removed FROM p LEFT JOIN f ON f.img_id = p.img_id AND f.x = p.x AND f.y = p.y GROUP BY 1""")
def auto_remove(spark, sf):
    """Background reached from all four corners, keyed on their mean level."""
    at_corner = F.col("x").isin(0, 7) & F.col("y").isin(0, 7)
    px = pixels(spark, sf).withColumn("key", F.floor(F.avg(F.when(at_corner, F.col("v"))).over(Window.partitionBy("img_id")) + 0.5))
    hit = M.flood(px, F.abs(F.col("v") - F.col("key")) < 60, at_corner, lambda df: written(df, "corners"))
    return hit.groupBy("img_id").agg(F.count_if("hit").alias("removed"))


@query(f"""WITH RECURSIVE {PIXELS}, s AS (SELECT img_id, v AS seed FROM pixels WHERE x = 3 AND y = 4), p AS (SELECT p.*, abs(v - seed) AS d FROM pixels p JOIN s ON s.img_id = p.img_id),
f AS (SELECT img_id, x, y FROM p WHERE x = 3 AND y = 4 UNION SELECT p.img_id, p.x, p.y FROM f JOIN p ON p.img_id = f.img_id AND p.d < 70 AND abs(p.x - f.x) + abs(p.y - f.y) = 1)
SELECT p.img_id, p.x, p.y, CAST(floor(v * (1 - greatest(0.0, least(1.0, (d - 30) / 40.0))) + 0.5) AS INTEGER) AS v FROM f JOIN p ON p.img_id = f.img_id AND p.x = f.x AND p.y = f.y""")
def flood_restore(spark, sf):
    """What a restoring flood from one pixel brings back from the source, feathered at its end."""
    at = (F.col("x") == 3) & (F.col("y") == 4)
    px = pixels(spark, sf).withColumn("seed", F.max(F.when(at, F.col("v"))).over(Window.partitionBy("img_id")))
    px = px.withColumn("d", F.abs(F.col("v") - F.col("seed")))
    hit = M.flood(px, F.col("d") < 70, at, lambda df: written(df, "restore")).where("hit")
    back = F.floor(F.col("v") * (1 - M.keep_factor(F.col("d"), 30, 40)) + 0.5)
    return hit.select("img_id", "x", "y", back.cast("int").alias("v"))


@query(f"""WITH {PIXELS}, h AS (SELECT img_id, md5(string_agg(v, ',' ORDER BY y, x)) AS h FROM pixels GROUP BY 1) SELECT a.img_id, coalesce(a.h = b.h, true) AS same FROM h a LEFT JOIN h b ON b.img_id = a.img_id + 250""")
def same_images(spark, sf):
    """Whether each image equals the one 250 places on; a missing one counts as equal."""
    p = pixels(spark, sf).groupBy("img_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("string")), ",")).alias("h"))
    other = p.select((F.col("img_id") - 250).alias("img_id"), F.col("h").alias("other"))
    return p.join(other, "img_id", "left").select("img_id", F.coalesce(F.col("h") == F.col("other"), F.lit(True)).alias("same"))


@query(f"""WITH {LABELS}, n AS (SELECT a.img_id, a.x, a.y, a.label, a.v, list(b.label) AS l FROM labels_px a JOIN labels_px b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT img_id, x, y, label, (SELECT k FROM (SELECT unnest(l) AS k) GROUP BY k ORDER BY count(*) DESC, (k = label) DESC, k LIMIT 1) AS after FROM n)
SELECT img_id, label, count(*) FILTER (WHERE after IS DISTINCT FROM label) AS changed, count(*) AS pixels FROM m GROUP BY 1, 2""")
def changed_mask(spark, sf):
    """How many pixels of each label a majority filter changes."""
    px = labels(spark, sf).select("img_id", "x", "y", "label")
    after = K.mode_filter(px).select("img_id", "x", "y", F.col("label").alias("after"))
    both = px.join(after, ["img_id", "x", "y"])
    return both.groupBy("img_id", "label").agg(F.count_if(~F.col("label").eqNullSafe(F.col("after"))).alias("changed"), F.count("*").alias("pixels"))


@query(f"""WITH {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id, label ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY img_id, label) AS n FROM labels_px WHERE label >= 0)
SELECT img_id, label, count(*) AS kept, CAST(sum(v) AS BIGINT) AS total FROM r WHERE i % greatest(1, CAST(ceil(n / 6.0) AS BIGINT)) = 0 GROUP BY 1, 2""")
def region_samples(spark, sf):
    """Pixels of each label at an even stride, so that at most six stay."""
    w = Window.partitionBy("img_id", "label")
    r = labels(spark, sf).where("label >= 0").withColumns({"i": F.row_number().over(w.orderBy("y", "x")) - 1, "n": F.count("*").over(w)})
    kept = r.where(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / 6.0)) == 0)
    return kept.groupBy("img_id", "label").agg(F.count("*").alias("kept"), F.sum("v").cast("long").alias("total"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey * 7 % (SELECT count(*) FROM part) END AS to_ FROM part),
w AS (SELECT id, to_ AS at, [id] AS seen, false AS loops FROM e WHERE to_ IS NOT NULL
 UNION ALL SELECT w.id, e.to_, list_append(seen, w.at), list_contains(seen, w.at) FROM w JOIN e ON e.id = w.at WHERE e.to_ IS NOT NULL AND NOT loops),
c AS (SELECT DISTINCT unnest(list_slice(seen, list_position(seen, seen[-1]), len(seen) - 1)) AS id FROM w WHERE loops),
f AS (SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN NULL ELSE to_ END AS to_ FROM e),
r AS (SELECT id, to_ AS at FROM f WHERE to_ IS NOT NULL UNION ALL SELECT r.id, f.to_ FROM r JOIN f ON f.id = r.at WHERE f.to_ IS NOT NULL)
SELECT f.id, r.at AS goal FROM f LEFT JOIN (SELECT r.id, r.at FROM r JOIN f ON f.id = r.at WHERE f.to_ IS NULL) r ON r.id = f.id""")
def compressed_routes(spark, sf):
    """Where each blend ends when routes are followed; members of a cycle are accepted again, so
    routes end there. Pointers jump, so rounds follow the logarithm of the longest route."""
    from ..sources.roles import table

    p, k = table(spark, sf, "part"), F.col("p_partkey")
    e = p.join(F.broadcast(p.agg(F.count("*").alias("n")))).select(k.alias("id"), F.when(F.col("p_size") % 3 != 0, k * 7 % F.col("n")).alias("to_"))
    return M.routed(e, lambda df: written(df, "routes")).select("id", F.col("to_").alias("goal"))


@query(f"""WITH RECURSIVE {PIXELS}, t AS (SELECT img_id, x, y, v, CASE WHEN 255 - v < 120 AND v >= 26 THEN 1 ELSE 0 END AS ink FROM pixels),
walk AS (SELECT img_id, x, y, y * 65536 + x AS comp FROM t WHERE ink = 1 UNION SELECT b.img_id, b.x, b.y, w.comp FROM walk w JOIN t b ON b.img_id = w.img_id AND b.ink = 1 AND abs(b.x - w.x) + abs(b.y - w.y) = 1),
c AS (SELECT img_id, x, y, min(comp) AS comp FROM walk GROUP BY 1, 2, 3), z AS (SELECT img_id, comp, count(*) AS area FROM c GROUP BY 1, 2),
o AS (SELECT t.img_id, t.v, coalesce(z.area >= 3, false) AS ink FROM t LEFT JOIN c ON c.img_id = t.img_id AND c.x = t.x AND c.y = t.y LEFT JOIN z ON z.img_id = c.img_id AND z.comp = c.comp)
SELECT img_id, count(*) FILTER (WHERE ink) AS ink_pixels, coalesce(round(avg(255 - v) FILTER (WHERE ink), 6), 255) AS ink_mean, coalesce(round(avg(255 - v) FILTER (WHERE NOT ink), 6), 255) AS paper_mean FROM o GROUP BY 1""")
def mono_labels(spark, sf):
    """Ink by a threshold, without components of fewer than three pixels; means of ink and paper."""
    ink = (255 - F.col("v") < 120) & (F.col("v") >= 26)
    px = pixels(spark, sf).withColumn("label", ink.cast("int"))
    c = K.components(px, False, lambda df: written(df, "mono")).withColumn("area", F.count("*").over(Window.partitionBy("img_id", "comp")))
    kept = (F.col("label") == 1) & (F.col("area") >= 3)
    mean = lambda ok: F.coalesce(F.round(F.avg(F.when(ok, 255 - F.col("v"))), 6), F.lit(255.0))
    return c.groupBy("img_id").agg(F.count_if(kept).alias("ink_pixels"), mean(kept).alias("ink_mean"), mean(~kept).alias("paper_mean"))


@query(f"""WITH {LABELS}, s AS (SELECT img_id, x, y FROM (SELECT img_id, x, y, abs(v - lag(v) OVER (PARTITION BY img_id, y ORDER BY x)) AS d FROM labels_px) WHERE coalesce(d, 99) < 12),
m AS (SELECT img_id, x, y FROM labels_px WHERE (x * 3 + y * 5 + img_id) % 11 = 0),
n AS (SELECT m.img_id, m.x, m.y, s.y * 8 + s.x AS pixel, greatest(abs(s.x - m.x), abs(s.y - m.y)) AS ring, CASE WHEN abs(s.y - m.y) = greatest(abs(s.x - m.x), abs(s.y - m.y)) THEN (s.x + 8) * 2 + (CASE WHEN s.y > m.y THEN 1 ELSE 0 END) ELSE 1000 + (s.y + 8) * 2 + (CASE WHEN s.x > m.x THEN 1 ELSE 0 END) END AS scan
 FROM m JOIN s ON s.img_id = m.img_id AND greatest(abs(s.x - m.x), abs(s.y - m.y)) <= 2)
SELECT m.img_id, m.x, m.y, coalesce(b.pixel, -1) AS pixel FROM m LEFT JOIN (SELECT img_id, x, y, arg_min(pixel, ring * 10000 + scan) AS pixel FROM n GROUP BY 1, 2, 3) b ON b.img_id = m.img_id AND b.x = m.x AND b.y = m.y""")
def smooth_neighbours(spark, sf):
    """The smooth pixel nearest to each marker, by rings of up to two pixels: upper and lower sides
    from the left, then the flanks from the top; -1 where there is none."""
    px = labels(spark, sf).withColumn("d", F.abs(F.col("v") - K.left("v")))
    smooth = px.where("d < 12").select("img_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    marks = px.where("(x * 3 + y * 5 + img_id) % 11 = 0").select("img_id", "x", "y")
    reach = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3)]
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in reach]))
    near = marks.select("img_id", "x", "y", around.alias("r")).withColumns({"sx": F.col("x") + F.col("r.dx"), "sy": F.col("y") + F.col("r.dy")})
    near = near.join(smooth, ["img_id", "sx", "sy"])
    dx, dy = F.abs(F.col("r.dx")), F.abs(F.col("r.dy"))
    ring = F.greatest(dx, dy)
    sides = F.struct(ring.alias("ring"), (dy != ring).alias("flank"), F.when(dy == ring, F.col("sx")).otherwise(F.col("sy")).alias("at"), F.when(dy == ring, F.col("r.dy") > 0).otherwise(F.col("r.dx") > 0).alias("far"), (F.col("sy") * 8 + F.col("sx")).alias("pixel"))
    best = near.groupBy("img_id", "x", "y").agg(F.min(sides).alias("b"))
    return marks.join(best, ["img_id", "x", "y"], "left").select("img_id", "x", "y", F.coalesce("b.pixel", F.lit(-1)).alias("pixel"))


@query(f"""WITH {LABELS}, n AS (SELECT img_id, label, count(*) AS n, avg(v) AS m FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
d AS (SELECT img_id, label, v, count(*) AS c FROM labels_px WHERE label >= 0 AND (x + y) % 5 <> 0 GROUP BY 1, 2, 3), b AS (SELECT img_id, label, v, row_number() OVER (PARTITION BY img_id, label ORDER BY c DESC, v) AS r FROM d)
SELECT n.img_id, row_number() OVER (PARTITION BY n.img_id ORDER BY n DESC, n.label) - 1 AS place, n.label, n, CAST(coalesce(b.v, floor(m + 0.5)) AS INTEGER) AS tone, printf('#%02x%02x%02x', n.label * 60, 255 - n.label * 60, 128) AS shown FROM n LEFT JOIN b ON b.img_id = n.img_id AND b.label = n.label AND b.r = 1""")
def ordered_palette(spark, sf):
    """Labels of each image by falling size, with their most frequent level outside a mask (their
    mean where the mask leaves none) and the colour that shows them."""
    px = labels(spark, sf).where("label >= 0")
    n = px.groupBy("img_id", "label").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    d = px.where("(x + y) % 5 <> 0").groupBy("img_id", "label", "v").agg(F.count("*").alias("c"))
    b = d.groupBy("img_id", "label").agg((-F.max(F.struct("c", (-F.col("v")).alias("low")))["low"]).alias("mode"))
    place = F.row_number().over(Window.partitionBy("img_id").orderBy(F.col("n").desc(), "label")) - 1
    shown = X.channels_to_hex(F.col("label") * 60, 255 - F.col("label") * 60, F.lit(128))
    tone = F.coalesce("mode", F.floor(F.col("m") + 0.5)).cast("int")
    return n.join(b, ["img_id", "label"], "left").select("img_id", place.cast("long").alias("place"), "label", "n", tone.alias("tone"), shown.alias("shown"))
