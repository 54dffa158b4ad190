"""Queries of matte cleanup, ink decisions, sheet splitting, gradients and geometry scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import formats as Z
from ..operators import matte as M
from ..operators import raster as K
from ..operators import sequence as Q
from ..operators import spatial as D
from ..operators import stats as S
from ..sources.roles import LABELS, PIXELS, labels, pixels, table
from ..sources.scratch import written
from .registry import query


@query(f"""WITH RECURSIVE {PIXELS}, f AS (SELECT img_id, x, y FROM pixels WHERE v < 160 AND (x IN (0, 7)) AND (y IN (0, 7))
 UNION SELECT p.img_id, p.x, p.y FROM f JOIN pixels p ON p.img_id = f.img_id AND p.v < 160 AND abs(p.x - f.x) + abs(p.y - f.y) = 1)
SELECT p.img_id, count(f.img_id) AS removed, sum(CASE WHEN f.img_id IS NULL THEN p.v ELSE 0 END) AS ink_left FROM pixels p LEFT JOIN f ON f.img_id = p.img_id AND f.x = p.x AND f.y = p.y GROUP BY 1""")
def flood_remove(spark, sf):
    """Background reached from the four corners through levels under a tolerance."""
    corner = F.col("x").isin(0, 7) & F.col("y").isin(0, 7)
    hit = M.flood(pixels(spark, sf), F.col("v") < 160, corner, lambda df: written(df, "flood"))
    return hit.groupBy("img_id").agg(F.count_if("hit").alias("removed"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("v"))).alias("ink_left"))


@query(f"""WITH {PIXELS}, c AS (SELECT img_id, floor(avg(v) + 0.5) AS key FROM pixels WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY 1)
SELECT p.img_id, x, y, round(greatest(0.0, least(1.0, (abs(v - key) - 24) / 40.0)) * v, 6) AS v FROM pixels p JOIN c ON p.img_id = c.img_id""")
def remove_color(spark, sf):
    """Global colour key on the mean corner level, with a feather."""
    px = pixels(spark, sf)
    corner = F.col("x").isin(0, 7) & F.col("y").isin(0, 7)
    key = F.floor(F.avg(F.when(corner, F.col("v"))).over(Window.partitionBy("img_id")) + 0.5)
    px = px.withColumn("key", key)
    return px.select("img_id", "x", "y", F.round(M.keep_factor(F.abs(F.col("v") - F.col("key")), 24, 40) * F.col("v"), 6).alias("v"))


def _box(n: int, over: str, source: str, name: str) -> str:
    other = "x" if over == "y" else "y"
    return f"{name} AS (SELECT a.img_id, a.x, a.y, avg(b.v) AS v FROM {source} a JOIN {source} b ON a.img_id = b.img_id AND a.{over} = b.{over} AND abs(a.{other} - b.{other}) <= {n} GROUP BY 1, 2, 3)"


@query(f"WITH {PIXELS}, {_box(1, 'y', 'pixels', 'h1')}, {_box(1, 'y', 'h1', 'h2')}, {_box(1, 'x', 'h2', 'v1')}, {_box(1, 'x', 'v1', 'v2')} SELECT img_id, x, y, round(v, 6) AS v FROM v2")
def feather_alpha(spark, sf):
    px = pixels(spark, sf).withColumn("v", F.col("v").cast("double"))
    return M.feathered(px, "v", 1, passes=2).select("img_id", "x", "y", F.round("v", 6).alias("v"))


@query(f"""WITH {LABELS}, h AS (SELECT img_id, x, y, max(n) AS a, max(CASE WHEN r = 1 THEN l END) AS l FROM (SELECT a.img_id, a.x, a.y, b.v AS n, b.label AS l,
  row_number() OVER (PARTITION BY a.img_id, a.x, a.y ORDER BY b.v DESC, (b.x = a.x) DESC, b.x) AS r FROM labels_px a JOIN labels_px b ON a.img_id = b.img_id AND a.y = b.y AND abs(a.x - b.x) <= 1) GROUP BY 1, 2, 3)
SELECT img_id, x, y, CAST(a AS INTEGER) AS v, CAST(l AS INTEGER) AS label FROM (SELECT a.img_id, a.x, a.y, b.a, b.l, row_number() OVER (PARTITION BY a.img_id, a.x, a.y ORDER BY b.a DESC, (b.y = a.y) DESC, b.y) AS r FROM h a JOIN h b ON a.img_id = b.img_id AND a.x = b.x AND abs(a.y - b.y) <= 1) WHERE r = 1""")
def grow_matte(spark, sf):
    return M.grown(labels(spark, sf), "v", ["label"], 1).select("img_id", "x", "y", "v", "label")


def _seams_sql() -> str:
    lines = {"r": "img_id, y ORDER BY x", "c": "img_id, x ORDER BY y", "d": "img_id, x - y ORDER BY x", "u": "img_id, x + y ORDER BY x"}
    tests = []
    for w in lines:
        at = lambda k, w=w: f"{'lead' if k > 0 else 'lag'}(v, {abs(k)}) OVER {w}"
        for size in (1, 2, 3):
            for i in range(size):
                a, b = at(-i - 1), at(size - i)
                inside = [f"{at(k)} >= 100" for k in range(-i, size - i) if k]
                tests.append(" AND ".join([*inside, f"{a} < 100", f"{b} < 100", f"abs(v - ({a} + ({b} - {a}) * ({i + 1}.0::DOUBLE / {size + 1}))) <= 48"]))
    found = " OR ".join(f"coalesce({t}, false)" for t in tests)
    windows = ", ".join(f"{w} AS (PARTITION BY {line})" for w, line in lines.items())
    return f"WITH {PIXELS}, s AS (SELECT img_id, v >= 100 AND ({found}) AS seam FROM pixels WINDOW {windows}) SELECT img_id, count(*) FILTER (WHERE seam) AS seams FROM s GROUP BY 1"


@query(_seams_sql())
def close_seams(spark, sf):
    """Thin opaque runs between removed flanks whose level is their blend."""
    s = M.seams(pixels(spark, sf), F.col("v") >= 100, "v", 48.0)
    return s.groupBy("img_id").agg(F.count_if("seam").alias("seams"))


@query(f"""WITH {LABELS}, n AS (SELECT a.img_id, a.x, a.y, a.label, b.label AS other, abs(a.v - b.v) AS d FROM labels_px a JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
b AS (SELECT img_id, x, y, label, bool_or(other = label) AS same, arg_min(other, d * 10 + other) FILTER (WHERE d <= 30) AS near FROM n GROUP BY 1, 2, 3, 4)
SELECT img_id, x, y, CAST(CASE WHEN same THEN label ELSE coalesce(near, label) END AS INTEGER) AS label FROM b""")
def heal_spikes(spark, sf):
    return M.healed(labels(spark, sf), 30, 1).select("img_id", "x", "y", F.col("label").cast("int").alias("label"))


@query(f"""WITH {PIXELS} SELECT img_id, round(avg(CAST(v < 247 AS INTEGER)), 9) AS ink, round(sum(CAST(v AS DOUBLE) * (255 - v)) / sum(255 - v), 6) AS luma, min(v) FILTER (WHERE v >= 26) AS low, max(v) AS high,
 list_sort(list(v) FILTER (WHERE x IN (0, 7) OR y IN (0, 7)))[15] AS ring FROM pixels GROUP BY 1""")
def ink_probe(spark, sf):
    """Share of ink, weighted luma, its range, and the upper median of the border ring."""
    v = F.col("v")
    ring = F.when(F.col("x").isin(0, 7) | F.col("y").isin(0, 7), v)
    return pixels(spark, sf).groupBy("img_id").agg(
        F.round(F.avg((v < 247).cast("double")), 9).alias("ink"),
        F.round(F.sum(v * (255.0 - v)) / F.sum(255 - v), 6).alias("luma"),
        F.min(F.when(v >= 26, v)).alias("low"),
        F.max(v).alias("high"),
        F.element_at(F.sort_array(F.collect_list(ring)), 15).alias("ring"),
    )


@query(f"""WITH {PIXELS}, b AS (SELECT img_id, CAST(floor(v / 8.0) AS INTEGER) AS bin FROM pixels GROUP BY 1, 2),
g AS (SELECT img_id, bin, lead(bin) OVER (PARTITION BY img_id ORDER BY bin) - bin - 1 AS gap FROM b)
SELECT img_id, gap, CAST((bin + 1) * 8 AS BIGINT) AS from_ FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY gap DESC NULLS LAST, bin) AS r FROM g) WHERE r = 1""")
def histogram_gap(spark, sf):
    """The widest empty stretch of each image's histogram."""
    b = pixels(spark, sf).select("img_id", F.floor(F.col("v") / 8).cast("int").alias("bin")).distinct()
    gap = F.lead("bin").over(Window.partitionBy("img_id").orderBy("bin")) - F.col("bin") - 1
    g = b.withColumn("gap", gap)
    best = F.max(F.struct(F.coalesce("gap", F.lit(-1)).alias("order"), (-F.col("bin")).alias("low"), F.col("gap").alias("gap")))
    return g.groupBy("img_id").agg(best.alias("b")).select("img_id", F.col("b.gap").alias("gap"), ((1 - F.col("b.low")) * 8).cast("long").alias("from_"))


@query(f"""WITH {LABELS}, i AS (SELECT img_id, y, x, x - row_number() OVER (PARTITION BY img_id, y ORDER BY x) AS g FROM labels_px WHERE label >= 2),
r AS (SELECT img_id, count(*) AS thick FROM i GROUP BY img_id, y, g), h AS (SELECT img_id, thick, sum(thick) AS n FROM r GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY thick) AS c, sum(n) OVER (PARTITION BY img_id) AS a FROM h) SELECT img_id, min(thick) FILTER (WHERE c >= 0.75 * a) AS thickness FROM c GROUP BY 1""")
def ink_thickness(spark, sf):
    """The smallest run length up to which three quarters of the ink lie."""
    i = labels(spark, sf).where("label >= 2").withColumn("g", F.col("x") - F.row_number().over(K.row()))
    h = i.groupBy("img_id", "y", "g").agg(F.count("*").alias("thick")).groupBy("img_id", "thick").agg(F.sum("thick").alias("n"))
    w = Window.partitionBy("img_id")
    c = h.withColumns({"c": F.sum("n").over(w.orderBy("thick")), "a": F.sum("n").over(w)})
    return c.where("c >= 0.75 * a").groupBy("img_id").agg(F.min("thick").alias("thickness"))


@query(f"""WITH {LABELS}, r AS (SELECT img_id, y, count(*) FILTER (WHERE label >= 2) AS ink FROM labels_px GROUP BY 1, 2), k AS (SELECT img_id, y, y - row_number() OVER (PARTITION BY img_id ORDER BY y) AS g, ink FROM r WHERE ink >= 2)
SELECT img_id, min(y) AS y0, max(y) AS y1, sum(ink) AS ink FROM k GROUP BY img_id, g""")
def sheet_bands(spark, sf):
    """Bands of rows with ink: islands of the row profile."""
    r = labels(spark, sf).groupBy("img_id", "y").agg(F.count_if(F.col("label") >= 2).alias("ink")).where("ink >= 2")
    b = Q.interval_islands(r.withColumn("y1", F.col("y")), ["img_id"], "y", "y1", 1)
    inked = r.join(b, "img_id").where("y between from_ and to_")
    return inked.groupBy("img_id", F.col("from_").alias("y0"), F.col("to_").alias("y1")).agg(F.sum("ink").alias("ink"))


@query(f"""WITH {LABELS} SELECT img_id, CAST(floor(x / 4) AS INTEGER) AS mx, CAST(floor(y / 4) AS INTEGER) AS my, bool_or(label >= 2) AS mask, count(*) FILTER (WHERE label >= 2) AS weight FROM labels_px GROUP BY 1, 2, 3""")
def sheet_mask(spark, sf):
    ink = F.col("label") >= 2
    return labels(spark, sf).groupBy("img_id", F.floor(F.col("x") / 4).cast("int").alias("mx"), F.floor(F.col("y") / 4).cast("int").alias("my")).agg(
        F.bool_or(ink).alias("mask"), F.count_if(ink).alias("weight")
    )


@query(f"""WITH {LABELS}, t AS (SELECT img_id, label, least(3, CAST(floor((x + y) / 3.5) AS INTEGER)) AS bin, v FROM labels_px WHERE label >= 0)
SELECT img_id, label, bin, count(*) AS n, round(avg(v), 6) AS mean FROM t GROUP BY 1, 2, 3""")
def binned_profile(spark, sf):
    """Mean level of each region along a diagonal, in bins."""
    t = F.least(F.lit(3), F.floor((F.col("x") + F.col("y")) / 3.5).cast("int"))
    return labels(spark, sf).where("label >= 0").groupBy("img_id", "label", t.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {LABELS}, m AS (SELECT img_id, label, count(*) AS n, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) AS vv, CAST(count(*) * sum((x + y) * (x + y)) - sum(x + y) * sum(x + y) AS DOUBLE) AS tt,
 CAST(count(*) * sum((x + y) * v) - sum(x + y) * sum(v) AS DOUBLE) AS vt FROM labels_px WHERE label >= 0 GROUP BY 1, 2)
SELECT img_id, label, CASE WHEN sqrt(vv) / n / 255 + CAST(0.0045 AS DOUBLE) <= sqrt(greatest(CAST(0 AS DOUBLE), vv - CASE WHEN tt > 0 THEN vt * vt / tt ELSE 0 END)) / n / 255 + CAST(0.015 AS DOUBLE) THEN 'solid' ELSE 'linear' END AS model FROM m""")
def paint_ladder(spark, sf):
    """The cheaper of a flat paint and a diagonal ramp: residual plus a price for each parameter, three
    and ten of 0.0015. Sums are of integers, so neither their order nor rounding has a say: a ramp that
    fits in full leaves nothing."""
    m = labels(spark, sf).where("label >= 0").select("img_id", "label", F.col("v").cast("long").alias("v"), (F.col("x") + F.col("y")).cast("long").alias("t"))
    spread = lambda p, q: (F.count("*") * F.sum(F.col(p) * F.col(q)) - F.sum(p) * F.sum(q)).cast("double")
    m = m.groupBy("img_id", "label").agg(F.count("*").alias("n"), spread("v", "v").alias("vv"), spread("t", "t").alias("tt"), spread("t", "v").alias("vt"))
    fitted = F.when(F.col("tt") > 0, F.col("vt") * F.col("vt") / F.col("tt")).otherwise(0.0)
    cost = lambda squares, price: F.sqrt(squares) / F.col("n") / 255 + price
    solid, linear = cost(F.col("vv"), 0.0045), cost(F.greatest(F.lit(0.0), F.col("vv") - fitted), 0.015)
    return m.select("img_id", "label", F.when(solid <= linear, "solid").otherwise("linear").alias("model"))


@query(f"""WITH {LABELS}, e AS (SELECT DISTINCT a.img_id, a.x, a.y FROM labels_px a JOIN labels_px b ON a.img_id = b.img_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND (a.label >= 2) <> (b.label >= 2) WHERE a.label >= 2),
d AS (SELECT a.img_id, a.x, a.y, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM e a JOIN e b ON b.img_id = a.img_id + 1 GROUP BY 1, 2, 3)
SELECT img_id, count(*) AS n, round(avg(d), 6) AS chamfer, round(list_sort(list(d))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1], 6) AS p95, round(max(d), 6) AS hausdorff FROM d GROUP BY 1""")
def score_geometry(spark, sf):
    """Distances from each image's ink boundary to that of the image after it."""
    px = labels(spark, sf).withColumn("ink", (F.col("label") >= 2).cast("int"))
    edge = K.with_cross(px, "ink").where("ink = 1 and (l = 0 or r = 0 or u = 0 or d = 0)").select("img_id", "x", "y")
    pts = edge.select("img_id", (F.col("img_id") * 1024 + F.col("y") * 8 + F.col("x")).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    others = pts.select((F.col("img_id") - 1).alias("img_id"), F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = D.nearest(pts, others, 2.0, ["img_id"], lambda df: written(df, "boundary"))
    d = written(d, "distances")
    p95 = S.at_ranks(d, ["img_id"], "distance", {"p95": S.floored(0.95)}).select("img_id", F.round("p95", 6).alias("p95"))
    return d.groupBy("img_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("chamfer"), F.round(F.max("distance"), 6).alias("hausdorff")).join(p95, "img_id")


@query(f"WITH {PIXELS} SELECT img_id, max(x) + 1 AS width, max(y) + 1 AS height, CAST(sum(v) AS BIGINT) AS total FROM pixels GROUP BY 1")
def png_round_trip(spark, sf):
    """Each raster encoded as PNG, read back and summed."""
    files = Z.encode_images(pixels(spark, sf))
    back = Z.decode_images(files)
    return back.groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum("v").alias("total"))


@query(f"WITH {LABELS} SELECT img_id, label, CAST(count(*) AS DOUBLE) AS area FROM labels_px WHERE label >= 0 GROUP BY 1, 2")
def svg_round_trip(spark, sf):
    """Each image traced without tolerance, written as a drawing, parsed back, areas measured."""
    from ..operators.geometry import traced

    shapes = Z.parse_drawings(Z.write_drawings(traced(labels(spark, sf), tolerance=0.0)))
    return shapes.select("img_id", "label", "area")


@query("""SELECT p_brand AS parent, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_partkey) AS ord FROM part""")
def reorder_front(spark, sf):
    """Chosen items move to the front of their parent; the order among others stays."""
    w = Window.partitionBy("p_brand").orderBy((F.col("p_size") > 25).desc(), "p_partkey")
    return table(spark, sf, "part").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("id"), F.row_number().over(w).cast("long").alias("ord"))


@query("""WITH b AS (SELECT p_brand AS g, p_partkey AS id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS w FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, coalesce(sum(w) OVER (PARTITION BY g ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 sum(w) OVER (PARTITION BY g) AS all_w, min(x) OVER (PARTITION BY g) AS x0, max(x + w) OVER (PARTITION BY g) AS x1 FROM b)
SELECT g, id, round(CASE WHEN n < 3 THEN x ELSE x0 + before + i * (x1 - x0 - all_w) / (n - 1) END, 6) AS x FROM o""")
def distribute_items(spark, sf):
    """Equal gaps between the outer edges of the extremes."""
    w = Window.partitionBy("g")
    o = w.orderBy("x", "id")
    b = table(spark, sf, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("w"))
    b = b.withColumns(
        {
            "i": F.row_number().over(o) - 1,
            "n": F.count("*").over(w),
            "before": F.coalesce(F.sum("w").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "all_w": F.sum("w").over(w),
            "x0": F.min("x").over(w),
            "x1": F.max(F.col("x") + F.col("w")).over(w),
        }
    )
    at = F.col("x0") + F.col("before") + F.col("i") * (F.col("x1") - F.col("x0") - F.col("all_w")) / (F.col("n") - 1)
    return b.select("g", "id", F.round(F.when(F.col("n") < 3, F.col("x")).otherwise(at), 6).alias("x"))
