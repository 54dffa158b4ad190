"""Queries of curve sets: coverage both ways and joined ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import stats as S
from ..sources.roles import VECTORS, dealt, table
from ..sources.scratch import written
from .registry import query

#: A vector's curves: twelve points in two curves, and the same without every third point in one.
CURVES = """pt AS (SELECT vec_id AS g, i, 10 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 10 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(12) t(i)),
cv AS (SELECT g, 'a' AS side, i // 6 AS curve, i, x, y FROM pt UNION ALL SELECT g, 't', 0, i, x, y FROM pt WHERE i % 3 <> 1),
sg AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cv WINDOW w AS (PARTITION BY g, side, curve ORDER BY i)),
ln AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM sg WHERE nx IS NOT NULL),
dn AS (SELECT *, sum(len) OVER (PARTITION BY g, side, curve ORDER BY i ROWS UNBOUNDED PRECEDING) AS done FROM ln),
sm AS MATERIALIZED (SELECT g, side, curve, k, x + (k * 0.5 - (done - len)) / len * (nx - x) AS x, y + (k * 0.5 - (done - len)) / len * (ny - y) AS y
 FROM (SELECT *, unnest(range(CAST(ceil(round((done - len) / 0.5, 9)) AS BIGINT), CAST(ceil(round(done / 0.5, 9)) AS BIGINT))) AS k FROM dn WHERE len > 0)),
ds AS MATERIALIZED (SELECT a.g, a.side, a.curve, a.k, sqrt(min(round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 12))) AS d FROM sm a JOIN sm b ON b.g = a.g AND b.side <> a.side GROUP BY 1, 2, 3, 4)"""


def _curves(spark, sf):
    e = F.col("embedding")
    points = F.array(*[F.struct(F.lit(i).alias("i"), *[(10 * e[2 * i + c].cast("double")).alias(n) for c, n in enumerate("xy")]) for i in range(12)])
    p = dealt(table(spark, sf, "embeddings"), VECTORS, "vec_id").select(F.col("vec_id").alias("g"), F.explode(points).alias("p")).select("g", "p.*")
    return p.withColumn("curve", F.floor(F.col("i") / 6)), p.where("i % 3 <> 1").withColumn("curve", F.lit(0).cast("long"))


@query(f"""WITH {CURVES}, cover AS (SELECT g, curve, max(k) * 0.5 AS length, count(*) FILTER (WHERE d <= 0.4 AND before) * 0.5 AS covered, count(*) FILTER (WHERE d <= 0.4 AND NOT before) AS stretches
 FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY g, curve ORDER BY k) <= 0.4, false) AS before FROM ds WHERE side = 'a') GROUP BY 1, 2),
ranks AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM ds WHERE side = 't')
SELECT c.g, round(t.centre, 6) AS centre, round(t.p95, 6) AS centre_p95, round(m.missed, 6) AS missed, round(c.length, 6) AS length, round(c.covered, 6) AS covered, c.stretches
FROM (SELECT g, sum(length) AS length, sum(covered) AS covered, sum(stretches) AS stretches FROM cover GROUP BY 1) c
JOIN (SELECT g, avg(d) AS centre, max(d) FILTER (WHERE r = floor(round(0.95 * (n - 1), 9))) AS p95 FROM ranks GROUP BY 1) t ON t.g = c.g JOIN (SELECT g, avg(d) AS missed FROM ds WHERE side = 'a' GROUP BY 1) m ON m.g = c.g""")
def line_scores(spark, sf):
    """How far traced curves lie from the drawn ones, how much of these they miss, and what length of
    them is covered within a tolerance, in how many stretches."""
    drawn, traced = _curves(spark, sf)
    keep = lambda df: written(df, "line-scores")
    d = keep(L.mutual_distances(drawn, traced, ["g"], 0.5, keep))
    there, back = d.where("other"), d.where("not other")
    cover = L.covered(back, ["g"], 0.5, 0.4).groupBy("g").agg(F.sum("length").alias("length"), F.sum("covered").alias("covered"), F.sum("stretches").alias("stretches"))
    p95 = S.at_ranks(there, ["g"], "distance", {"p95": S.floored(0.95)})
    centre = there.groupBy("g").agg(F.avg("distance").alias("centre"))
    missed = back.groupBy("g").agg(F.avg("distance").alias("missed"))
    out = centre.join(p95, "g").join(missed, "g").join(cover, "g")
    return out.select("g", *[F.round(c, 6).alias(n) for c, n in (("centre", "centre"), ("p95", "centre_p95"), ("missed", "missed"), ("length", "length"), ("covered", "covered"))], "stretches")


@query()
def joined_curves(spark, sf):
    """Curves of eight vectors each whose free ends lie near each other, joined end to end."""
    drawn, _ = _curves(spark, sf)
    c = drawn.select(F.floor(F.col("g") / 8).alias("sheet"), (F.col("g") * 2 + F.col("curve")).alias("curve"), "i", "x", "y")
    j = L.joined_ends(c, ["sheet"], 1.2, lambda df: written(df, "joined"))
    return j.groupBy("sheet", "path").agg(F.max("closed").alias("closed"), F.count("*").alias("nodes"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
