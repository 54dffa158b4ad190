"""Queries of colour spaces, colour text and paint models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colours as C
from ..functions import scalars as X
from ..sources.roles import LABELS, PIXELS, labels, pixels, table
from .registry import query


def _colours(spark, sf):
    """A colour for each part: three channels from its key and size."""
    p = table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("id"), (k * 37 % 256).cast("int").alias("r"), (k * 91 % 256).cast("int").alias("g"), (s * 5).alias("b"))


COLOURS = "c AS (SELECT p_partkey AS id, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_size * 5 AS b FROM part)"


def _light(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _ok(source: str, r: str = "r", g: str = "g", b: str = "b", keep: str = "id") -> str:
    """Tables lin, cone and ok: Oklab of the channels of ``source``."""
    return f"""lin AS (SELECT {keep}, {_light(r)} AS lr, {_light(g)} AS lg, {_light(b)} AS lb FROM {source}),
cone AS (SELECT {keep}, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS l, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS m,
 cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS s FROM lin),
ok AS (SELECT {keep}, 0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s AS ol, 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s AS oa,
 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s AS ob FROM cone)"""


@query(f"WITH {COLOURS}, {_ok('c')} SELECT ok.id, round(ol, 6) AS l, round(oa, 6) AS a, round(ob, 6) AS b, round(0.2126 * c.r + 0.7152 * c.g + 0.0722 * c.b, 6) AS luma FROM ok JOIN c ON c.id = ok.id")
def oklab_colors(spark, sf):
    rgb = [F.col(x) for x in "rgb"]
    ok = [F.round(x, 6).alias(n) for x, n in zip(C.oklab(*rgb), "lab", strict=True)]
    return _colours(spark, sf).select("id", *ok, F.round(C.luma709(*rgb), 6).alias("luma"))


@query(f"""WITH {COLOURS}, {_ok('c')}, xyz AS (SELECT id, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS tx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS ty,
 (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS tz, 0.2126 * lr + 0.7152 * lg + 0.0722 * lb AS y FROM lin),
f AS (SELECT id, y, {', '.join(f"CASE WHEN t{n} > 216.0 / 24389 THEN cbrt(t{n}) ELSE (24389.0 / 27 * t{n} + 16) / 116 END AS f{n}" for n in 'xyz')} FROM xyz),
lab AS (SELECT id, y, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f)
SELECT p.id, round(sqrt(pow(o.ol - q.ol, 2) + pow(o.oa - q.oa, 2) + pow(o.ob - q.ob, 2)), 6) AS ok_distance,
 round(abs(p.l - n.l) + abs(p.a - n.a) + abs(p.b - n.b), 4) AS l1_lab, round((greatest(p.y, n.y) + 0.05) / (least(p.y, n.y) + 0.05), 6) AS contrast
FROM lab p JOIN lab n ON n.id = p.id + 1 JOIN ok o ON o.id = p.id JOIN ok q ON q.id = n.id""")
def color_gaps(spark, sf):
    """Each colour beside the next one: Oklab distance, L1 distance in CIELAB, contrast of the pair
    as hexadecimal text."""
    c = _colours(spark, sf).withColumn("hex", X.channels_to_hex(F.col("r"), F.col("g"), F.col("b")))
    a, b = c.alias("a"), c.select((F.col("id") - 1).alias("id"), "r", "g", "b", "hex").alias("b")
    one, two = ([F.col(f"{t}.{n}") for n in "rgb"] for t in "ab")
    contrast = X.contrast(*[X.luminance(*X.hex_to_rgb(F.col(f"{t}.hex"))) for t in "ab"])
    return a.join(b, F.col("a.id") == F.col("b.id")).select(
        F.col("a.id").alias("id"),
        F.round(X.distance(C.oklab(*one), C.oklab(*two)), 6).alias("ok_distance"),
        F.round(C.l1(X.lab(*one), X.lab(*two)), 4).alias("l1_lab"),
        F.round(contrast, 6).alias("contrast"),
    )


#: Texts of colours in every form, from a part's key k and size s.
FORMS = """CASE k % 8 WHEN 0 THEN concat('#', {hex2}(k % 256), {hex2}(s * 5), {hex2}(k * 7 % 256)) WHEN 1 THEN concat(' #', {hex1}(k % 16), {hex1}(s % 16), {hex1}(k * 3 % 16), {hex1}(k * 5 % 16))
 WHEN 2 THEN concat('rgb(', k % 256, ', ', s, '%, ', k * 7 % 256, ')') WHEN 3 THEN concat('RGBA( ', k % 300, ' ', s, ' 12 / 50% )') WHEN 4 THEN concat('hsl(', k % 360, 'deg ', s, '% 40%)')
 WHEN 5 THEN concat('hsla(', s, 'grad, 50%, ', s, '%, .25)') WHEN 6 THEN CASE WHEN s > 25 THEN 'Tomato' ELSE 'transparent' END ELSE concat('var(--c', k, ')') END"""


def _forms(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    hex2 = lambda c: f"lower(lpad(hex({c}), 2, '0'))"
    text = FORMS
    for c in ("k % 256", "s * 5", "k * 7 % 256"):
        text = text.replace("{hex2}(" + c + ")", hex2(c))
    for c in ("k % 16", "s % 16", "k * 3 % 16", "k * 5 % 16"):
        text = text.replace("{hex1}(" + c + ")", f"lower(hex({c}))")
    return p.withColumn("text", F.expr(text))


def _hsl(h: str, s: str, light: str, k: int) -> str:
    place = f"(({k} + ({h}) / 30.0) - 12 * floor(({k} + ({h}) / 30.0) / 12))"
    return f"255 * ({light} - {s} * least({light}, 1 - {light}) * greatest(-1.0, least({place} - 3, 9 - {place}, 1.0)))"


def _channel(i: int) -> str:
    at, k = "rgb"[i], (0, 8, 4)[i]
    return f"""CASE k % 8 WHEN 0 THEN {('k % 256', 's * 5', 'k * 7 % 256')[i]} WHEN 1 THEN 17 * ({('k % 16', 's % 16', 'k * 3 % 16')[i]}) WHEN 2 THEN {('k % 256', 's * 2.55', 'k * 7 % 256')[i]}
 WHEN 3 THEN {('least(255, k % 300)', 's', '12')[i]} WHEN 4 THEN {_hsl('k % 360', 's / 100.0', '0.4', k)} WHEN 5 THEN {_hsl('s * 0.9', '0.5', '(s / 100.0)', k)}
 WHEN 6 THEN CASE WHEN s > 25 THEN {(255, 99, 71)[i]} ELSE 0 END END AS {at}"""


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), v AS (SELECT k, {_channel(0)}, {_channel(1)}, {_channel(2)},
 CASE k % 8 WHEN 1 THEN k * 5 % 16 / 15.0 WHEN 3 THEN 0.5 WHEN 5 THEN 0.25 WHEN 6 THEN CASE WHEN s > 25 THEN 1 ELSE 0 END WHEN 7 THEN NULL ELSE 1 END AS a FROM p)
SELECT k, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM v""")
def css_colors(spark, sf):
    """Colours read from text in every form; null where the text names none."""
    c = _forms(spark, sf).withColumn("c", C.css_color(F.col("text")))
    return c.select("k", *[F.round(f"c.{x}", 6).alias(x) for x in "rgba"])


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k, CASE k % 6 WHEN 0 THEN printf('#%02x%02x%02x', k % 256, s * 5, k * 7 % 256) WHEN 1 THEN printf('#%x%x%x%x%x%x', k % 16, k % 16, s % 16, s % 16, k * 3 % 16, k * 3 % 16)
 WHEN 2 THEN printf('#%02x%02x%02x', k % 256, CAST(floor(s * 255 / 100.0 + 0.5) AS BIGINT), k * 7 % 256) WHEN 3 THEN 'url(#g' || k || ')' WHEN 4 THEN CASE WHEN s > 25 THEN '#008080' WHEN s > 12 THEN '#000000' END ELSE 'inherit' END AS paint FROM p""")
def norm_paints(spark, sf):
    """Paints in one form: hexadecimal digits, references, nothing."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    h = lambda c, n: f"lpad(hex({c}), {n}, '0')"
    text = f"""CASE k % 6 WHEN 0 THEN concat('#', {h('k % 256', 2)}, {h('s * 5', 2)}, {h('k * 7 % 256', 2)}, '80') WHEN 1 THEN concat('#', {h('k % 16', 1)}, {h('s % 16', 1)}, {h('k * 3 % 16', 1)})
     WHEN 2 THEN concat('rgb(', k % 256, ' ', s, '% ', k * 7 % 256, ' / 0.5)') WHEN 3 THEN concat('url( "#g', k, '")') WHEN 4 THEN CASE WHEN s > 25 THEN ' Teal !important' WHEN s > 12 THEN 'currentColor' ELSE 'none' END ELSE 'inherit' END"""
    return p.select("k", C.paint(F.expr(text)).alias("paint"))


STOPS = [(0.0, 10.0), (0.4, 200.0), (1.0, 90.0)]
PLACES = f"""{LABELS}, t AS (SELECT img_id, x, y, v, label, least(1.0, greatest(0.0, ((x - 1) * 5 + (y - 2) * 4) / 41.0)) AS lt,
 (x - 2.5) * 1.0 + (y - 3.0) * 0.5 AS along, pow(x - 2.5, 2) + pow(y - 3.0, 2) AS far FROM labels_px),
r AS (SELECT *, CASE WHEN far = 0 THEN 0.0 ELSE least(1.0, far / (along + sqrt(along * along + 23.75 * far))) END AS rt FROM t),
g AS (SELECT *, {', '.join(f"CASE WHEN {n} <= 0.4 THEN 10 + {n} / 0.4 * 190 ELSE 200 - ({n} - 0.4) / 0.6 * 110 END AS {m}" for n, m in (('lt', 'lv'), ('rt', 'rv')))} FROM r)"""


def _places(spark, sf):
    x, y = F.col("x"), F.col("y")
    one = lambda *v: [F.lit(float(a)) for a in v]
    px = labels(spark, sf).withColumns({"lt": C.linear_place(*one(1, 2, 6, 6), x, y), "rt": C.radial_place(*one(3.5, 3.5, 5, 2.5, 3.0), x, y)})
    return px.withColumns({"lv": C.between_stops(STOPS, F.col("lt")), "rv": C.between_stops(STOPS, F.col("rt"))})


@query(f"WITH {PLACES} SELECT img_id, x, y, round(lt, 6) AS linear_t, round(rt, 6) AS radial_t, round(lv, 5) AS linear_v, round(rv, 5) AS radial_v FROM g")
def gradient_samples(spark, sf):
    """Places and values of every pixel on a linear gradient and on a radial one with a focus."""
    r = lambda c, n, name: F.round(c, n).alias(name)
    return _places(spark, sf).select("img_id", "x", "y", r("lt", 6, "linear_t"), r("rt", 6, "radial_t"), r("lv", 5, "linear_v"), r("rv", 5, "radial_v"))


@query(f"""WITH {PLACES}, {_ok('(SELECT *, v AS id FROM (SELECT DISTINCT v FROM g))', 'v', 'v', 'v')}, m AS (SELECT img_id, x, y, label, lv AS w FROM g WHERE label >= 0),
lin2 AS (SELECT img_id, x, y, label, {_light('w')} AS light FROM m), ok2 AS (SELECT img_id, x, y, label, cbrt(light) AS root FROM lin2)
SELECT g.img_id, g.label, round(sqrt(avg(3 * pow(g.v - g.lv, 2))), 5) AS rgb, round(sqrt(avg(pow(ok.ol - root * (0.2104542553 + 0.793617785 - 0.0040720468), 2) + pow(ok.oa - root * (1.9779984951 - 2.428592205 + 0.4505937099), 2)
 + pow(ok.ob - root * (0.0259040371 + 0.7827717662 - 0.808675766), 2))), 5) AS oklab FROM g JOIN ok ON ok.id = g.v JOIN ok2 ON ok2.img_id = g.img_id AND ok2.x = g.x AND ok2.y = g.y WHERE g.label >= 0 GROUP BY 1, 2""")
def model_residuals(spark, sf):
    """How far a gradient strays from each region's pixels: root mean squares over channels and in Oklab."""
    px = _places(spark, sf).where("label >= 0")
    v, m = F.col("v"), F.col("lv")
    ok = X.distance(C.oklab(v, v, v), C.oklab(m, m, m))
    root = lambda c: F.round(F.sqrt(F.avg(F.pow(c, F.lit(2)))), 5)
    return px.groupBy("img_id", "label").agg(F.round(F.sqrt(F.avg(3 * F.pow(v - m, F.lit(2)))), 5).alias("rgb"), root(ok).alias("oklab"))


@query(f"""WITH {LABELS}, m AS (SELECT img_id, label, avg(v) AS mean FROM labels_px WHERE label >= 0 GROUP BY 1, 2), d AS (SELECT p.img_id, p.label, cbrt({_light('p.v')}) - cbrt({_light('m.mean')}) AS d FROM labels_px p JOIN m ON m.img_id = p.img_id AND m.label = p.label)
SELECT img_id, label, round(sqrt(avg(d * d * (pow(0.2104542553 + 0.793617785 - 0.0040720468, 2) + pow(1.9779984951 - 2.428592205 + 0.4505937099, 2) + pow(0.0259040371 + 0.7827717662 - 0.808675766, 2)))), 6) AS residual FROM d GROUP BY 1, 2""")
def solid_residual(spark, sf):
    """Root mean square in Oklab of each region's pixels around its mean colour."""
    px = labels(spark, sf).where("label >= 0")
    mean = px.groupBy("img_id", "label").agg(F.avg("v").alias("mean"))
    d = X.distance(C.oklab(F.col("v"), F.col("v"), F.col("v")), C.oklab(F.col("mean"), F.col("mean"), F.col("mean")))
    return px.join(mean, ["img_id", "label"]).groupBy("img_id", "label").agg(F.round(F.sqrt(F.avg(d * d)), 6).alias("residual"))


def _covariance(p, q):
    return f"CAST(count(*) * sum({p} * {q}) - sum({p}) * sum({q}) AS DOUBLE) / (count(*) * count(*))"


MOMENTS = f"m AS (SELECT img_id, label, count(*) AS n, {', '.join(f'{_covariance(*pq)} AS {k}' for k, pq in zip('abcuw', ('xx', 'xy', 'yy', 'xv', 'yv')))} FROM labels_px WHERE label >= 0 GROUP BY 1, 2)"


def _moments(spark, sf):
    """Covariances from sums of integers, so that equal ones are equal and none is nearly zero."""
    pairs = {"a": ("x", "x"), "b": ("x", "y"), "c": ("y", "y"), "u": ("x", "v"), "w": ("y", "v")}
    px = labels(spark, sf).where("label >= 0").select("img_id", "label", *[F.col(c).cast("long").alias(c) for c in "xyv"])
    covariance = lambda p, q: (F.count("*") * F.sum(F.col(p) * F.col(q)) - F.sum(p) * F.sum(q)).cast("double") / (F.count("*") * F.count("*"))
    return px.groupBy("img_id", "label").agg(F.count("*").alias("n"), *[covariance(p, q).alias(k) for k, (p, q) in pairs.items()])


@query(f"""WITH {LABELS}, {MOMENTS}, e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS size FROM m)
SELECT img_id, label, round(CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 1 ELSE 0 END ELSE b / sqrt(b * b + pow(size - a, 2)) END, 5) AS ax, round(CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 0 ELSE 1 END ELSE (size - a) / sqrt(b * b + pow(size - a, 2)) END, 5) AS ay,
 round(CASE WHEN abs(a * c - b * b) >= 1e-9 THEN (c * u - b * w) / (a * c - b * b) END + 1e-9, 5) AS gx, round(CASE WHEN abs(a * c - b * b) >= 1e-9 THEN (a * w - b * u) / (a * c - b * b) END + 1e-9, 5) AS gy FROM e WHERE n >= 6""")
def region_axes(spark, sf):
    """The main axis of each region's shape, and the slope of its level where the system has a solution."""
    m = _moments(spark, sf).where("n >= 6")
    a, b, c, u, w = (F.col(k) for k in "abcuw")
    axis, slope = C.main_axis(a, b, c), C.solved(a, b, c, u, w)
    # a slope may lie just between two roundings
    r = lambda s, n, name, up=0.0: F.round(s[n] + up, 5).alias(name)
    return m.select("img_id", "label", r(axis, "x", "ax"), r(axis, "y", "ay"), r(slope, "x", "gx", 1e-9), r(slope, "y", "gy", 1e-9))


CENTRES = """e AS (SELECT img_id, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, (min(x) + max(x)) / 2.0 AS bx, (min(y) + max(y)) / 2.0 AS byy, min(v * 65536 + y * 256 + x) AS lo, max(v * 65536 - y * 256 - x) AS hi FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
c AS (SELECT img_id, label, 0 AS k, mx AS cx, my AS cy FROM e UNION ALL SELECT img_id, label, 1, bx, byy FROM e
 UNION ALL SELECT p.img_id, p.label, 2, p.x, p.y FROM labels_px p JOIN e ON e.img_id = p.img_id AND e.label = p.label AND e.lo = p.v * 65536 + p.y * 256 + p.x
 UNION ALL SELECT p.img_id, p.label, 3, p.x, p.y FROM labels_px p JOIN e ON e.img_id = p.img_id AND e.label = p.label AND e.hi = p.v * 65536 - p.y * 256 - p.x),
d AS (SELECT c.*, p.v, sqrt(pow(p.x - cx, 2) + pow(p.y - cy, 2)) AS d FROM c JOIN labels_px p ON p.img_id = c.img_id AND p.label = c.label),
f0 AS (SELECT img_id, label, k, cx, cy, max(d) AS r, count(*) AS n, var_pop(v) AS vv, 1 - coalesce(CASE WHEN var_pop(v) > 0 AND var_pop(d) > 1e-18 THEN pow(covar_pop(v, d), 2) / (var_pop(v) * var_pop(d)) END, 0) AS free FROM d GROUP BY 1, 2, 3, 4, 5 HAVING max(d) > 1e-6),
f AS (SELECT *, CASE WHEN free < 1e-12 THEN 0 ELSE sqrt(vv * free) END AS residual FROM f0),
b AS (SELECT *, row_number() OVER (PARTITION BY img_id, label ORDER BY round(residual, 6), k) AS place FROM f)"""


def _radial(spark, sf):
    """The best centre of each region: its centroid, the middle of its box, its darkest and its
    lightest pixel are tried; the level is a linear function of the distance. Distances that differ by
    rounding alone are one, and a share of the variance that rounding alone leaves is none."""
    px = labels(spark, sf).where("label >= 0")
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    place = lambda s: F.struct(s, y, x)
    low, high = F.min(place(v.alias("o"))), F.min(place((-v).alias("o")))
    e = px.groupBy("img_id", "label").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), ((F.min("x") + F.max("x")) / 2.0).alias("bx"), ((F.min("y") + F.max("y")) / 2.0).alias("by"), low.alias("lo"), high.alias("hi")
    )
    at = [("mx", "my"), ("bx", "by"), ("lo.x", "lo.y"), ("hi.x", "hi.y")]
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("cx"), F.col(b).cast("double").alias("cy")) for k, (a, b) in enumerate(at)]))
    d = px.join(e.select("img_id", "label", tried.alias("c")), ["img_id", "label"])
    d = d.withColumn("d", F.sqrt(F.pow(x - F.col("c.cx"), F.lit(2)) + F.pow(y - F.col("c.cy"), F.lit(2))))
    both = F.var_pop("v") * F.var_pop("d")
    apart = (F.var_pop("v") > 0) & (F.var_pop("d") > 1e-18)
    free = 1 - F.coalesce(F.when(apart, F.pow(F.covar_pop("v", "d"), F.lit(2)) / both), F.lit(0.0))
    f = d.groupBy("img_id", "label", "c").agg(F.max("d").alias("r"), F.count("*").alias("n"), F.var_pop("v").alias("vv"), free.alias("free")).where("r > 1e-6")
    f = f.withColumn("residual", F.when(F.col("free") < 1e-12, 0.0).otherwise(F.sqrt(F.col("vv") * F.col("free"))))
    best = F.min(F.struct(F.round("residual", 6).alias("o"), F.col("c.k").alias("k"), "c", "r", "residual"))
    return f.groupBy("img_id", "label").agg(best.alias("b"))


@query(f"WITH {LABELS}, {CENTRES} SELECT img_id, label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r, round(residual, 4) AS residual FROM b WHERE place = 1")
def radial_fit(spark, sf):
    b = _radial(spark, sf)
    return b.select("img_id", "label", *[F.round(f"b.c.{c}", 6).alias(c) for c in ("cx", "cy")], F.round("b.r", 6).alias("r"), F.round("b.residual", 4).alias("residual"))


@query(f"""WITH {LABELS}, {CENTRES}, {MOMENTS}, s AS (SELECT img_id, label, var_pop(v) AS vv FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
l AS (SELECT m.img_id, m.label, m.n, sqrt(greatest(0, vv - CASE WHEN abs(a * c - b * b) >= 1e-9 THEN ((c * u - b * w) * u + (a * w - b * u) * w) / (a * c - b * b) ELSE 0 END)) AS plane, sqrt(vv) AS flat FROM m JOIN s ON s.img_id = m.img_id AND s.label = m.label)
SELECT l.img_id, l.label, CASE WHEN round(flat / 255 + 0.0045, 6) <= round(least(plane / 255 + 0.015, coalesce(b.residual, flat) / 255 + 0.015), 6) THEN 'solid' WHEN round(plane, 4) <= round(coalesce(b.residual, flat), 4) THEN 'linear' ELSE 'radial' END AS model
FROM l LEFT JOIN b ON b.img_id = l.img_id AND b.label = l.label AND b.place = 1 WHERE l.n >= 6""")
def best_paint(spark, sf):
    """The cheapest of a flat paint, a ramp in any direction and a radial one: residual plus a price
    for each parameter; of a ramp and a radial one that fit alike the ramp."""
    m = _moments(spark, sf).where("n >= 6")
    vv = labels(spark, sf).where("label >= 0").groupBy("img_id", "label").agg(F.var_pop("v").alias("vv"))
    a, b, c, u, w = (F.col(k) for k in "abcuw")
    s = C.solved(a, b, c, u, w)
    plane = F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - F.coalesce(s["x"] * u + s["y"] * w, F.lit(0.0))))
    radial = _radial(spark, sf).select("img_id", "label", F.col("b.residual").alias("radial"))
    j = m.join(vv, ["img_id", "label"]).join(radial, ["img_id", "label"], "left").withColumns({"flat": F.sqrt("vv"), "plane": plane})
    j = j.withColumn("radial", F.coalesce("radial", "flat"))
    price = lambda r, k: r / 255 + 0.0015 * k
    cheap = F.round(price(F.col("flat"), 3), 6) <= F.round(F.least(price(F.col("plane"), 10), price(F.col("radial"), 10)), 6)
    model = F.when(cheap, "solid").when(F.round("plane", 4) <= F.round("radial", 4), "linear").otherwise("radial")
    return j.select("img_id", "label", model.alias("model"))


@query(f"""WITH {PIXELS}, s AS (SELECT img_id, sum((0.299 * v + 0.587 * (255 - v) + 0.114 * 200) / 255 * v) / nullif(sum(v), 0) AS light, avg(CASE WHEN v < 16 THEN 1.0 ELSE 0.0 END) AS clear,
 sum(CASE WHEN v >= 16 THEN (0.299 * v + 0.587 * (255 - v) + 0.114 * 200) / 255 * v END) / nullif(sum(CASE WHEN v >= 16 THEN v END), 0) AS shown FROM pixels GROUP BY 1)
SELECT img_id, round(light, 6) AS light, coalesce(round(light, 6) > 0.45, false) AS is_light, coalesce(round(shown, 6) > 0.45 AND clear > 0.02, false) AS wants_dark FROM s""")
def light_images(spark, sf):
    """Whether the ink, weighted by its opacity (the level), is light, and whether it stands on
    enough transparency to want a dark ground."""
    v = F.col("v")
    luma = (0.299 * v + 0.587 * (255 - v) + 0.114 * 200) / 255
    shown = F.when(v >= 16, v)
    s = pixels(spark, sf).groupBy("img_id").agg(
        F.round(F.try_divide(F.sum(luma * v), F.sum(v)), 6).alias("light"), F.round(F.try_divide(F.sum(luma * shown), F.sum(shown)), 6).alias("shown"), F.avg((v < 16).cast("double")).alias("clear")
    )
    dark = (F.col("shown") > 0.45) & (F.col("clear") > 0.02)
    return s.select("img_id", "light", F.coalesce(F.col("light") > 0.45, F.lit(False)).alias("is_light"), F.coalesce(dark, F.lit(False)).alias("wants_dark"))


@query(f"""WITH {PIXELS}, k AS (SELECT img_id, (v // 8) * 1024 + ((255 - v) // 8) * 32 + 25 AS key, count(*) AS n FROM pixels WHERE v >= 26 GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY img_id) AS a, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, key) AS r FROM k)
SELECT img_id, count(*) FILTER (WHERE n >= 0.02 * a) AS colors, round(sum(n) FILTER (WHERE r <= 8) / max(a), 9) AS top FROM t GROUP BY 1""")
def color_spread(spark, sf):
    """How many colours of five bits a channel hold a share of the ink, and what the first eight hold."""
    from pyspark.sql import Window

    v = F.col("v")
    key = F.shiftright(v, 3) * 1024 + F.shiftright(255 - v, 3) * 32 + 25
    k = pixels(spark, sf).where("v >= 26").groupBy("img_id", key.alias("key")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("img_id")
    t = k.withColumns({"a": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("n").desc(), "key"))})
    top = F.sum(F.when(F.col("r") <= 8, F.col("n"))) / F.max("a")
    return t.groupBy("img_id").agg(F.count_if(F.col("n") >= 0.02 * F.col("a")).alias("colors"), F.round(top, 9).alias("top"))
