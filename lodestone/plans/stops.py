"""Queries of colour profiles and the stops of gradients with several."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colours as C
from ..operators import profile as P
from ..sources.roles import MOSAICS, mosaics
from ..sources.scratch import written
from .paints import _light
from .registry import query

#: A band of eight rows of a sheet is a region with a gradient from left to right.
BANDS = MOSAICS + """, smp AS MATERIALIZED (SELECT img_id * 8 + y // 8 AS g, x / 63.0::DOUBLE AS t, CAST(v AS DOUBLE) AS r, 255.0 - v AS gr, (v * 3 % 256)::DOUBLE AS b FROM mosaic),
prof AS MATERIALIZED (SELECT g, least(15, floor(t * 16))::INTEGER AS i, avg(t) AS t, avg(r) AS r, avg(gr) AS gr, avg(b) AS b FROM smp GROUP BY 1, 2)"""
VALUES = ["r", "gr", "b"]
TOLERANCE = 0.06


def _bands(spark, sf):
    v = F.col("v")
    g = (F.col("img_id") * 8 + F.floor(F.col("y") / 8)).alias("g")
    return mosaics(spark, sf).select(g, (F.col("x") / 63.0).alias("t"), v.cast("double").alias("r"), (255.0 - v).alias("gr"), (v * 3 % 256).cast("double").alias("b"))


def _lab_sql(r: str, g: str, b: str) -> list[str]:
    light = [_light(f"({c})") for c in (r, g, b)]
    roots = ["cbrt(" + " + ".join(f"{w} * ({x})" for w, x in zip(row, light, strict=True)) + ")" for row in C.CONES]
    return ["(" + " + ".join(f"({w}) * {x}" for w, x in zip(row, roots, strict=True)) + ")" for row in C.OKLAB]


def _distance(point, chord):
    return F.sqrt(sum((a - b) * (a - b) for a, b in zip(C.oklab(*point), C.oklab(*chord), strict=True)))


def _split_sql() -> str:
    chord = [f"lo.{c} + (hi.{c} - lo.{c}) * ((p.t - lo.t) / (hi.t - lo.t))" for c in VALUES]
    gaps = " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_lab_sql("p.r", "p.gr", "p.b"), _lab_sql("c0", "c1", "c2"), strict=True))
    return f"""WITH RECURSIVE {BANDS}, seg AS (SELECT g, min(i) AS lo, max(i) AS hi FROM prof GROUP BY g
 UNION ALL SELECT g, unnest([lo, mid]), unnest([mid, hi]) FROM (
  SELECT p.g, p.lo, p.hi, max_by(p.i, sqrt({gaps})) AS mid, max(sqrt({gaps})) AS away FROM (
   SELECT s.g, s.lo, s.hi, p.i, p.r, p.gr, p.b, {', '.join(f'{c} AS c{k}' for k, c in enumerate(chord))} FROM seg s JOIN prof p ON p.g = s.g AND p.i > s.lo AND p.i < s.hi
    JOIN prof lo ON lo.g = s.g AND lo.i = s.lo JOIN prof hi ON hi.g = s.g AND hi.i = s.hi) p GROUP BY 1, 2, 3) WHERE away > {TOLERANCE}),
kn AS MATERIALIZED (SELECT g, i, t, r, gr, b FROM prof WHERE (g, i) IN (SELECT g, lo FROM seg UNION SELECT g, hi FROM seg))"""


@query(_split_sql() + " SELECT g, i, round(t, 6) AS t, round(r, 4) AS r, round(gr, 4) AS gr, round(b, 4) AS b FROM kn")
def split_profiles(spark, sf):
    """The bins of each band's profile at which it leaves the straight line between its neighbours."""
    p = P.binned(_bands(spark, sf), ["g"], VALUES, 16)
    s = P.split(p, ["g"], VALUES, _distance, TOLERANCE, lambda df: written(df, "profiles"))
    return s.select("g", "i", F.round("t", 6).alias("t"), *[F.round(c, 4).alias(c) for c in VALUES])


def _stops_sql() -> str:
    sums = ", ".join(f"sum((1 - w) * {c}) AS u_{c}, sum(w * {c}) AS w_{c}" for c in VALUES)
    right = ", ".join(f"coalesce(a.u_{c}, 0) + coalesce(z.w_{c}, 0) + 1e-6 * n * k.{c} AS q_{c}" for c in VALUES)
    first = ", ".join(f"q_{c} / dg AS d_{c}" for c in VALUES)
    down = ", ".join(f"(s.q_{c} - p.up * p.d_{c}) / (s.dg - p.up * p.c)" for c in VALUES)
    last = ", ".join(f"d_{c} AS x_{c}" for c in VALUES)
    back = ", ".join(f"e.d_{c} - e.c * p.x_{c}" for c in VALUES)
    return f"""{_split_sql()},
k AS MATERIALIZED (SELECT *, CASE WHEN j = 0 THEN 0 WHEN j = m - 1 THEN 1 ELSE t END AS pl FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY g) AS m FROM kn)),
hat AS (SELECT s.*, a.j, greatest(0, least(1, (s.t - a.pl) / (z.pl - a.pl))) AS w FROM smp s JOIN k a ON a.g = s.g JOIN k z ON z.g = s.g AND z.j = a.j + 1
 WHERE (a.j = 0 OR s.t > a.pl) AND (z.j = z.m - 1 OR s.t <= z.pl)),
sm AS MATERIALIZED (SELECT g, j, sum((1 - w) * (1 - w)) AS uu, sum(w * w) AS ww, sum((1 - w) * w) AS uw, {sums} FROM hat GROUP BY 1, 2),
ct AS (SELECT g, count(*) AS n FROM smp GROUP BY 1),
sys AS MATERIALIZED (SELECT k.g, k.j, k.m, k.pl, coalesce(a.uu, 0) + coalesce(z.ww, 0) + 1e-6 * n AS dg, coalesce(a.uw, 0) AS up, {right}
 FROM k JOIN ct USING (g) LEFT JOIN sm a ON a.g = k.g AND a.j = k.j LEFT JOIN sm z ON z.g = k.g AND z.j = k.j - 1),
el AS (SELECT g, j, m, pl, up, up / dg AS c, {first} FROM sys WHERE j = 0
 UNION ALL SELECT s.g, s.j, s.m, s.pl, s.up, s.up / (s.dg - p.up * p.c), {down} FROM el p JOIN sys s ON s.g = p.g AND s.j = p.j + 1),
elm AS MATERIALIZED (SELECT * FROM el),
bk AS (SELECT g, j, pl, {last} FROM elm WHERE j = m - 1 UNION ALL SELECT e.g, e.j, e.pl, {back} FROM bk p JOIN elm e ON e.g = p.g AND e.j = p.j - 1)
SELECT g, CAST(j AS INTEGER) AS j, round(pl, 6) AS t, {', '.join(f'round(greatest(0, least(255, x_{c})), 3) AS {c}' for c in VALUES)} FROM bk"""


@query(_stops_sql())
def gradient_stops(spark, sf):
    """The stops of each band's gradient: places where its profile bends, colours by least squares."""
    s = written(_bands(spark, sf), "bands")
    bends = P.split(P.binned(s, ["g"], VALUES, 16), ["g"], VALUES, _distance, TOLERANCE, lambda df: written(df, "stop-profiles"))
    out = P.stops(s, bends, ["g"], VALUES)
    return out.select("g", "j", F.round("t", 6).alias("t"), *[F.round(c, 3).alias(c) for c in VALUES])
