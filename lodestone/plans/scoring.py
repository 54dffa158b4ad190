"""Queries that score one drawing or run against another, and the tests on the boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import raster as K
from ..operators import sequence as Q
from ..operators import stats as S
from ..sources.roles import CELLS, LABELS, PIXELS, SCORES, cells, labels, pixels, scores, table
from .boards import FRIEDMAN, RANKED
from .graphs import CHAIN, _chain
from .registry import query

TAILS = """, t AS (SELECT k, n, chi2, (n - 1) * chi2 / (n * (k - 1) - chi2) AS f FROM fr), p AS (SELECT *, (k - 1) * (n - 1) AS d2, (k - 1) * (n - 1) / ((k - 1) * (n - 1) + (k - 1) * f) AS u FROM t)"""


@query(f"""WITH {RANKED} {FRIEDMAN} {TAILS} SELECT k, n, CASE k WHEN 5 THEN round(exp(-chi2 / 2) * (1 + chi2 / 2), 9) WHEN 3 THEN round(exp(-chi2 / 2), 9) END AS p_chi2,
 CASE k WHEN 5 THEN round(pow(u, d2 / 2) * (1 + d2 / 2 * (1 - u)), 9) WHEN 3 THEN round(pow(u, d2 / 2), 9) END AS p_f FROM p""")
def friedman_tails(spark, sf):
    """Chances of ranks as far apart as these by both forms of the test. The SQL states the tails in
    closed form, which they have for the three or five tools that there are."""
    t = R.friedman(R.board(R.ranked_blocks(scores(spark, sf))).select("tool", F.col("case_mean_rank").alias("mean_rank"), "cases"))
    return R.with_tails(t).select("k", "n", F.round("p_chi2", 9).alias("p_chi2"), F.round("p_f", 9).alias("p_f"))


@query(f"""WITH {RANKED} SELECT count(*) AS k, max(cases) AS n, {', '.join(f"round(list_extract([{', '.join(map(str, q))}], CAST(count(*) - 1 AS INTEGER)) * sqrt(count(*) * (count(*) + 1) / (6.0 * max(cases))), 6) AS {name}" for name, q in (('cd_05', R.NEMENYI_05), ('cd_10', R.NEMENYI_10)))} FROM board""")
def critical_differences(spark, sf):
    """Differences of mean ranks that count, at both levels."""
    t = R.board(R.ranked_blocks(scores(spark, sf))).agg(F.count("*").alias("k"), F.max("cases").alias("n"))
    cd = lambda q: F.round(R.critical_difference(F.col("k"), F.col("n"), q), 6)
    return t.select("k", "n", cd(R.NEMENYI_05).alias("cd_05"), cd(R.NEMENYI_10).alias("cd_10"))


@query("SELECT p_partkey AS id, round(lgamma(p_size / 4.0), 9) AS ln_gamma FROM part")
def ln_gammas(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(R.ln_gamma(F.col("p_size") / 4.0), 9).alias("ln_gamma"))


VIEW = SCORES.replace("scores AS (", "all_scores AS (") + ", scores AS (SELECT * FROM all_scores WHERE tool <> 'error')"


@query(f"WITH {RANKED.replace(SCORES, VIEW)} SELECT 'headline' AS view, tool, round(mean_rank, 9) AS mean_rank, cases FROM board")
def headline_board(spark, sf):
    """The board of tools as their users get them: analyses are left out before ranks are taken."""
    b = R.board(R.ranked_blocks(scores(spark, sf).where("tool <> 'error'")))
    return b.select(F.lit("headline").alias("view"), "tool", F.round("mean_rank", 9).alias("mean_rank"), "cases")


@query(f"""WITH {CELLS}, p AS (SELECT a.tool, b.tool AS other, count(*) AS cases, bool_and(a.n = b.n) AS same, round(quantile_cont(a.top, 0.5), 6) AS median FROM cells a JOIN cells b ON b.case_id = a.case_id AND a.tool < b.tool GROUP BY 1, 2)
SELECT tool, other, cases, same, median FROM p""")
def same_output_pairs(spark, sf):
    """Pairs of tools with the cases they share, whether they agree in all, and the first one's median."""
    c = cells(spark, sf)
    b = c.select("case_id", F.col("tool").alias("other"), F.col("n").alias("on"))
    p = c.join(b, "case_id").where("tool < other")
    flat = p.groupBy("tool", "other").agg(F.count("*").alias("cases"), F.bool_and(F.col("n") == F.col("on")).alias("same"))
    low, high = S.interpolated(0.5)
    m = S.at_ranks(p, ["tool", "other"], "top", {"a": low, "b": high}).select("tool", "other", F.round(S.between("a", "b", 0.5), 6).alias("median"))
    return flat.join(m, ["tool", "other"])


@query("""WITH s AS (SELECT o_custkey AS id, year(o_orderdate) AS yr, sha256(string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey)) AS h FROM orders GROUP BY 1, 2)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'gone' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS verdict FROM (SELECT * FROM s WHERE yr = 1995) a FULL JOIN (SELECT * FROM s WHERE yr = 1996) b ON b.id = a.id""")
def snapshot_pairs(spark, sf):
    """Two frozen snapshots by case: equal bytes are unchanged."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"])
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("yr")).agg(F.sha2(F.array_join(w, ","), 256).alias("h"))
    a, b = (s.where(f"yr = {y}").select("id", F.col("h").alias(n)) for y, n in ((1995, "a"), (1996, "b")))
    verdict = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "id", "full").select("id", verdict.alias("verdict"))


@query("""WITH r AS (SELECT event_type AS config, user_id, CAST(sum(value) AS DOUBLE) AS total, count(*) AS stages, max(value) AS longest FROM events GROUP BY 1, 2)
SELECT config, round(min(total), 6) AS total, arg_min(stages, total * 1e6 + user_id / 1e6) AS stages, round(arg_min(longest, total * 1e6 + user_id / 1e6), 6) AS longest FROM r GROUP BY 1""")
def fastest_profiles(spark, sf):
    """The least total of each configuration over its rounds, and the stages of that round."""
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("config"), "user_id").agg(F.sum("value").alias("total"), F.count("*").alias("stages"), F.max("value").alias("longest"))
    best = r.groupBy("config").agg(F.min(F.struct("total", "user_id", "stages", "longest")).alias("b"))
    return best.select("config", F.round("b.total", 6).alias("total"), "b.stages", F.round("b.longest", 6).alias("longest"))


@query(f"""WITH {LABELS}, i AS (SELECT img_id, y, x, x - row_number() OVER (PARTITION BY img_id, y ORDER BY x) AS g FROM labels_px WHERE label >= 2), h AS (SELECT img_id, thick, sum(thick) AS n FROM (SELECT img_id, count(*) AS thick FROM i GROUP BY img_id, y, g) GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY thick) AS c, sum(n) OVER (PARTITION BY img_id) AS a FROM h)
SELECT img_id, q, min(thick) AS thickness FROM c, (SELECT unnest([0.25, 0.5, 0.9]) AS q) WHERE c >= greatest(1, ceil(a * q)) GROUP BY 1, 2""")
def thickness_at(spark, sf):
    """The smallest run length up to which each share of the ink lies."""
    i = labels(spark, sf).where("label >= 2").withColumn("g", F.col("x") - F.row_number().over(K.row()))
    h = i.groupBy("img_id", "y", "g").agg(F.count("*").alias("thick")).groupBy("img_id", "thick").agg(F.sum("thick").alias("n"))
    w = Window.partitionBy("img_id")
    c = h.withColumns({"c": F.sum("n").over(w.orderBy("thick")), "a": F.sum("n").over(w), "q": F.explode(F.array(*[F.lit(q).cast("decimal(3,2)") for q in (0.25, 0.5, 0.9)]))})
    return c.where(F.col("c") >= F.greatest(F.lit(1), F.ceil(F.col("a") * F.col("q")))).groupBy("img_id", "q").agg(F.min("thick").alias("thickness"))


@query(f"""WITH {PIXELS}, s AS (SELECT img_id, 8 - (img_id % 4 = 3)::INTEGER * 2 AS w FROM (SELECT DISTINCT img_id FROM pixels)), j AS (SELECT a.img_id, abs(a.v - b.v) AS d, sa.w AS wa, sb.w AS wb FROM pixels a JOIN pixels b ON b.img_id = a.img_id + 1 AND b.x = a.x AND b.y = a.y JOIN s sa ON sa.img_id = a.img_id JOIN s sb ON sb.img_id = b.img_id WHERE a.x < sa.w AND b.x < sb.w)
SELECT img_id, CASE WHEN max(greatest(wa, wb)) - max(least(wa, wb)) <= 1 THEN round(avg(d), 6) END AS gap FROM j GROUP BY 1""")
def source_gaps(spark, sf):
    """Mean difference over the common area of two rasters; null where their sizes differ by more
    than a pixel. Every fourth image counts as two columns narrower."""
    wide = 8 - (F.col("img_id") % 4 == 3).cast("int") * 2
    p = pixels(spark, sf).withColumn("w", wide).where("x < w").select("img_id", "x", "y", "v", "w")
    o = p.select((F.col("img_id") - 1).alias("img_id"), "x", "y", F.col("v").alias("ov"), F.col("w").alias("ow"))
    j = p.join(o, ["img_id", "x", "y"]).groupBy("img_id").agg(F.avg(F.abs(F.col("v") - F.col("ov"))).alias("gap"), F.max(F.abs(F.col("w") - F.col("ow"))).alias("differ"))
    return j.select("img_id", F.when(F.col("differ") <= 1, F.round("gap", 6)).alias("gap"))


@query(f"""WITH {PIXELS}, r AS (SELECT p.img_id, p.x, p.y, p.v, CASE WHEN p.img_id % 3 > 0 THEN q.v END AS rendered FROM pixels p LEFT JOIN pixels q ON q.img_id = p.img_id + 1 AND q.x = p.x AND q.y = p.y)
SELECT img_id, bool_and(rendered IS NULL) AS failed, round(avg(abs(v - coalesce(rendered, 255))), 6) AS mean_gap, round(avg(CASE WHEN abs(v - coalesce(rendered, 255)) > 40 THEN 1.0 ELSE 0.0 END), 6) AS far FROM r GROUP BY 1""")
def pixel_scores(spark, sf):
    """Pixel metrics of each case; a case without a rendering is held against white."""
    p = pixels(spark, sf)
    q = p.where((F.col("img_id") - 1) % 3 > 0).select((F.col("img_id") - 1).alias("img_id"), "x", "y", F.col("v").alias("rendered"))
    gap = F.abs(F.col("v") - F.coalesce("rendered", F.lit(255)))
    r = p.join(q, ["img_id", "x", "y"], "left")
    return r.groupBy("img_id").agg(F.bool_and(F.col("rendered").isNull()).alias("failed"), F.round(F.avg(gap), 6).alias("mean_gap"), F.round(F.avg((gap > 40).cast("double")), 6).alias("far"))


@query(f"""WITH {CHAIN}, s AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS byy FROM k WINDOW w AS (PARTITION BY g ORDER BY i))
SELECT g, i, (abs(ax * byy - ay * bx) < 1e-9 * (ax * ax + ay * ay)) AS straight FROM s WHERE sqrt(ax * ax + ay * ay) >= 5 AND sqrt(bx * bx + byy * byy) >= 5 AND round((ax * bx + ay * byy) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + byy * byy)), 9) <= 0.5""")
def sharp_corners(spark, sf):
    """Inner points of each chain that turn by 60 degrees or more between steps long enough, and
    whether the two steps lie on one line."""
    w = Window.partitionBy("g").orderBy("i")
    ax, ay = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    bx, by = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    c = _chain(spark, sf).withColumns({"ax": ax, "ay": ay, "bx": bx, "by_": by})
    a, b = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2), F.sqrt(F.col("bx") ** 2 + F.col("by_") ** 2)
    dot, cross = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by_"), F.col("ax") * F.col("by_") - F.col("ay") * F.col("bx")
    sharp = (a >= 5) & (b >= 5) & (F.round(dot / (a * b), 9) <= 0.5)
    return c.where(sharp).select("g", F.col("i").cast("long").alias("i"), (F.abs(cross) < 1e-9 * a * a).alias("straight"))


@query(f"""WITH {LABELS}, e AS (SELECT a.img_id, a.x, a.y, a.v AS va, b.v AS vb, c.v AS vc FROM labels_px a LEFT JOIN labels_px b ON b.img_id = a.img_id AND b.x = a.x - 1 AND b.y = a.y LEFT JOIN labels_px c ON c.img_id = a.img_id AND c.x = a.x + 1 AND c.y = a.y WHERE a.label >= 2)
SELECT img_id, count(*) FILTER (WHERE coalesce(abs(vb - vc) > 8 OR abs(va - vb) > 8 OR abs(va - vc) > 8, true)) AS visible, count(*) AS points FROM e GROUP BY 1""")
def visible_points(spark, sf):
    """Ink pixels at which the raster changes across; at its border a point counts as seen."""
    px = labels(spark, sf).withColumns({"b": K.left("v"), "c": K.right("v")}).where("label >= 2")
    v, b, c = F.col("v"), F.col("b"), F.col("c")
    seen = (F.abs(b - c) > 8) | (F.abs(v - b) > 8) | (F.abs(v - c) > 8)
    at_border = b.isNull() | c.isNull()
    return px.groupBy("img_id").agg(F.count_if(at_border | seen).alias("visible"), F.count("*").alias("points"))


@query(f"""WITH {CHAIN}, s AS (SELECT g, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS byy FROM k WINDOW w AS (PARTITION BY g ORDER BY i)), l AS (SELECT * FROM s WHERE bx IS NOT NULL AND (bx <> ax OR byy <> ay)),
q AS (SELECT g, avg(x) AS qx, avg(y) AS qy FROM k GROUP BY 1), t AS (SELECT l.*, qx, qy, greatest(0, least(1, ((qx - ax) * (bx - ax) + (qy - ay) * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)))) AS t FROM l JOIN q ON q.g = l.g),
d AS (SELECT *, sqrt(pow(qx - ax - t * (bx - ax), 2) + pow(qy - ay - t * (byy - ay), 2)) AS d, CASE WHEN (qx - ax) * (byy - ay) - (qy - ay) * (bx - ax) >= 0 THEN 1 ELSE -1 END AS side FROM t)
SELECT g, round(arg_min(d * side, round(d, 6) * 1e6 + i), 5) AS signed_distance FROM d GROUP BY g""")
def signed_nearest(spark, sf):
    """The distance from each chain's mean point to the chain, with the side it lies on."""
    w = Window.partitionBy("g").orderBy("i")
    k = _chain(spark, sf)
    seg = k.select("g", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_")).where("bx is not null and (bx <> ax or by_ <> ay)")
    t = seg.join(k.groupBy("g").agg(F.avg("x").alias("qx"), F.avg("y").alias("qy")), "g")
    dx, dy, ux, uy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"), F.col("qx") - F.col("ax"), F.col("qy") - F.col("ay")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ux * dx + uy * dy) / (dx * dx + dy * dy)))
    d = t.withColumn("t", at).withColumn("d", F.sqrt((ux - F.col("t") * dx) ** 2 + (uy - F.col("t") * dy) ** 2))
    signed = F.col("d") * F.when(ux * dy - uy * dx >= 0, 1).otherwise(-1)
    best = d.groupBy("g").agg(F.min(F.struct(F.round("d", 6).alias("o"), "i", signed.alias("s"))).alias("b"))
    return best.select("g", F.round("b.s", 5).alias("signed_distance"))


def _scale_sql(k: int) -> str:
    return f"s{k} AS (SELECT img_id, count(*) AS n, sum(m) AS ink FROM (SELECT img_id, x // {k} AS bx, y // {k} AS byy, avg(v) AS m FROM pixels GROUP BY 1, 2, 3) WHERE m >= 128 GROUP BY 1)"


@query(f"""WITH {PIXELS}, {_scale_sql(1)}, {_scale_sql(2)}, {_scale_sql(4)}, i AS (SELECT DISTINCT img_id FROM pixels)
SELECT i.img_id, round(coalesce(s1.n, 0) / 64.0, 6) AS full_, round(abs(coalesce(s2.n, 0) / 16.0 - coalesce(s1.n, 0) / 64.0), 6) AS drift_2, round(abs(coalesce(s4.n, 0) / 4.0 - coalesce(s1.n, 0) / 64.0), 6) AS drift_4
FROM i LEFT JOIN s1 ON s1.img_id = i.img_id LEFT JOIN s2 ON s2.img_id = i.img_id LEFT JOIN s4 ON s4.img_id = i.img_id""")
def scale_drift(spark, sf):
    """How far the share of ink moves when an image is read at a half and a quarter of its size."""
    px = pixels(spark, sf)
    share = lambda k: K.downscale(px, "v", k).groupBy("img_id").agg((F.count_if(F.col("v") >= 128) / F.count("*")).alias(f"s{k}"))
    j = share(1).join(share(2), "img_id").join(share(4), "img_id")
    drift = lambda k: F.round(F.abs(F.col(f"s{k}") - F.col("s1")), 6).alias(f"drift_{k}")
    return j.select("img_id", F.round("s1", 6).alias("full_"), drift(2), drift(4))


@query("""WITH e AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderkey * 7 % 50 AS a, o_orderkey * 11 % 50 AS b FROM orders), d AS (SELECT g, p, count(*) AS n FROM (SELECT g, a AS p FROM e UNION ALL SELECT g, b FROM e) GROUP BY 1, 2)
SELECT g, count(*) FILTER (WHERE n = 1) AS ends, count(*) FILTER (WHERE n > 2) AS joints, count(*) FILTER (WHERE n = 2) AS passed FROM d GROUP BY 1""")
def merged_ends(spark, sf):
    """Paths joined end to end: places where one path ends, two pass on, or more meet."""
    k = F.col("o_orderkey")
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.explode(F.array(k * 7 % 50, k * 11 % 50)).alias("p"))
    d = e.groupBy("g", "p").agg(F.count("*").alias("n"))
    return d.groupBy("g").agg(F.count_if(F.col("n") == 1).alias("ends"), F.count_if(F.col("n") > 2).alias("joints"), F.count_if(F.col("n") == 2).alias("passed"))


@query(f"""WITH {LABELS}, t AS (SELECT img_id, label, count(*) AS n, avg(v) AS m FROM labels_px WHERE label >= 0 GROUP BY 1, 2), r AS (SELECT a.img_id, a.label, a.n, bool_or(abs(b.m - a.m) <= 12 AND b.n * 2 >= a.n) AS found FROM t a LEFT JOIN t b ON b.img_id = a.img_id + 1 GROUP BY 1, 2, 3)
SELECT img_id, count(*) AS regions, count(*) FILTER (WHERE coalesce(found, false)) AS recovered, round(coalesce(sum(n) FILTER (WHERE found), 0) / sum(n), 6) AS ink_kept FROM r GROUP BY 1""")
def region_recovery(spark, sf):
    """Regions of each image that the one after it has too: a tone within reach, at half the size or more."""
    t = labels(spark, sf).where("label >= 0").groupBy("img_id", "label").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    o = t.select((F.col("img_id") - 1).alias("img_id"), F.col("n").alias("on"), F.col("m").alias("om"))
    hit = (F.abs(F.col("om") - F.col("m")) <= 12) & (F.col("on") * 2 >= F.col("n"))
    r = t.join(o, "img_id", "left").groupBy("img_id", "label", "n").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))
    kept = F.sum(F.when(F.col("found"), F.col("n")).otherwise(0)) / F.sum("n")
    return r.groupBy("img_id").agg(F.count("*").alias("regions"), F.count_if("found").alias("recovered"), F.round(kept, 6).alias("ink_kept"))


@query(f"""WITH {CHAIN}, c AS (SELECT g, avg(x) AS cx, avg(y) AS cy FROM k GROUP BY 1), r AS (SELECT k.g, cx, cy, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS r FROM k JOIN c ON c.g = k.g)
SELECT g, round(avg(r), 5) AS radius, round((max(r) - min(r)) / nullif(avg(r), 0), 6) AS spread, coalesce((max(r) - min(r)) / nullif(avg(r), 0) <= 0.5, false) AS circle FROM r GROUP BY 1 HAVING count(*) >= 3""")
def circle_recovery(spark, sf):
    """How round each chain is: the spread of its points' distances from their mean."""
    k = _chain(spark, sf)
    r = k.join(k.groupBy("g").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), "g").withColumn("r", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    s = r.groupBy("g").agg(F.count("*").alias("n"), F.avg("r").alias("m"), (F.max("r") - F.min("r")).alias("d")).where("n >= 3")
    spread = F.try_divide(F.col("d"), F.col("m"))
    return s.select("g", F.round("m", 5).alias("radius"), F.round(spread, 6).alias("spread"), F.coalesce(spread <= 0.5, F.lit(False)).alias("circle"))


@query(f"""WITH {CHAIN}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WINDOW w AS (PARTITION BY g ORDER BY i)), l AS (SELECT g, i, x, y, nx, ny, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM e WHERE nx IS NOT NULL),
c AS (SELECT *, sum(len) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS done FROM l), t AS (SELECT g, max(done) AS total FROM c GROUP BY 1)
SELECT g, k AS dash, round(k * 300.0, 6) AS from_, round(least(total, k * 300.0 + 200), 6) AS to_ FROM (SELECT g, total, unnest(range(0, CAST(ceil(round(total / 300, 9)) AS BIGINT))) AS k FROM t WHERE total > 0)""")
def dashes(spark, sf):
    """Dashes of 200 with gaps of 100 along each chain, as stretches of its length."""
    length = Q.turns(_chain(spark, sf), ["g"], "i").groupBy("g").agg(F.sum("length").alias("total")).where("total > 0")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.round(F.col("total") / 300, 9)).cast("long") - 1))
    d = length.select("g", "total", k.alias("dash"))
    return d.select("g", "dash", F.round(F.col("dash") * 300.0, 6).alias("from_"), F.round(F.least(F.col("total"), F.col("dash") * 300.0 + 200), 6).alias("to_"))
