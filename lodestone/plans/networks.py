"""Queries of boundary networks, hidden and invented shapes, fused tones and rows read from text files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import raster as K
from ..operators import segment as E
from ..operators import spatial as D
from ..sources.files import json_lines
from ..sources.roles import LABELS, labels, table
from ..sources.scratch import scratch_dir, written
from .edits import BOXES, _boxes
from .graphs import PTS, _points
from .registry import query

CRACKS = """g AS (SELECT img_id, x, y, label, coalesce(lag(label) OVER (PARTITION BY img_id, y ORDER BY x), -1) AS l, coalesce(lag(label) OVER (PARTITION BY img_id, x ORDER BY y), -1) AS u FROM labels_px),
e AS (SELECT img_id, x AS x0, y AS y0, x AS x1, y + 1 AS y1, l AS a, label AS b FROM g WHERE l <> label UNION ALL SELECT img_id, x, y, x + 1, y, u, label FROM g WHERE u <> label
 UNION ALL SELECT img_id, 8, y, 8, y + 1, label, -1 FROM g WHERE x = 7 AND label <> -1 UNION ALL SELECT img_id, x, 8, x + 1, 8, label, -1 FROM g WHERE y = 7 AND label <> -1)"""


@query(f"""WITH {LABELS}, {CRACKS}, s AS (SELECT img_id, x0, y0, x1, y1, a AS owner FROM e UNION ALL SELECT img_id, x0, y0, x1, y1, b FROM e)
SELECT img_id, owner, count(*) AS edges, count(*) FILTER (WHERE other = -1) AS outer_edges FROM (SELECT s.*, CASE WHEN s.owner = e.a THEN e.b ELSE e.a END AS other FROM s JOIN e USING (img_id, x0, y0, x1, y1)) WHERE owner >= 0 GROUP BY 1, 2""")
def edge_sides(spark, sf):
    """Each region's edges, and those whose other side lies outside."""
    e = K.cracks(labels(spark, sf))
    side = lambda own, other: F.struct(F.col(own).alias("owner"), F.col(other).alias("other"))
    s = e.select("img_id", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).where("s.owner >= 0")
    return s.groupBy("img_id", F.col("s.owner").alias("owner")).agg(F.count("*").alias("edges"), F.count_if(F.col("s.other") == -1).alias("outer_edges"))


@query(f"""WITH {LABELS}, {CRACKS}, m AS (SELECT img_id, 1 + img_id % 7 AS mx, 1 + img_id % 5 AS my FROM (SELECT DISTINCT img_id FROM labels_px))
SELECT e.img_id, count(*) AS touched, round(sum(sqrt(pow(CASE WHEN x0 = mx AND y0 = my THEN x0 + 0.25 ELSE x0 END - CASE WHEN x1 = mx AND y1 = my THEN x1 + 0.25 ELSE x1 END, 2)
 + pow(CASE WHEN x0 = mx AND y0 = my THEN y0 - 0.5 ELSE y0 END - CASE WHEN x1 = mx AND y1 = my THEN y1 - 0.5 ELSE y1 END, 2))), 6) AS length FROM e JOIN m ON m.img_id = e.img_id WHERE (x0 = mx AND y0 = my) OR (x1 = mx AND y1 = my) GROUP BY 1""")
def moved_vertices(spark, sf):
    """One vertex of each network moved: how many edges go with it, and how long they are then."""
    e = K.cracks(labels(spark, sf)).withColumns({"mx": 1 + F.col("img_id") % 7, "my": 1 + F.col("img_id") % 5})
    here = lambda k: (F.col(f"x{k}") == F.col("mx")) & (F.col(f"y{k}") == F.col("my"))
    at = {f"{c}{k}": F.when(here(k), F.col(f"{c}{k}") + d).otherwise(F.col(f"{c}{k}")) for k in (0, 1) for c, d in (("x", 0.25), ("y", -0.5))}
    moved = e.where(here(0) | here(1)).withColumns(at)
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return moved.groupBy("img_id").agg(F.count("*").alias("touched"), F.round(F.sum(length), 6).alias("length"))


@query(f"""WITH {LABELS}, {CRACKS}, v AS (SELECT DISTINCT img_id, x0 AS x, y0 AS y FROM e WHERE a <> 0 AND b <> 0 UNION SELECT DISTINCT img_id, x1, y1 FROM e WHERE a <> 0 AND b <> 0),
w AS (SELECT img_id, x0 AS x, y0 AS y FROM e UNION SELECT img_id, x1, y1 FROM e) SELECT w.img_id, count(*) AS vertices, count(*) FILTER (WHERE v.img_id IS NULL) AS pruned FROM w LEFT JOIN v ON v.img_id = w.img_id AND v.x = w.x AND v.y = w.y GROUP BY 1""")
def pruned_vertices(spark, sf):
    """Vertices that no edge refers to any more once all edges of one label are gone."""
    e = K.cracks(labels(spark, sf))
    ends = lambda d: d.select("img_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).distinct()
    kept = ends(e.where("a <> 0 and b <> 0")).withColumn("kept", F.lit(True))
    return ends(e).join(kept, ["img_id", "p"], "left").groupBy("img_id").agg(F.count("*").alias("vertices"), F.count_if(F.col("kept").isNull()).alias("pruned"))


@query(f"""WITH {BOXES} SELECT b.g, b.id, bool_or(o.id IS NOT NULL) AS hidden FROM b LEFT JOIN b o ON o.g = b.g AND o.id > b.id AND b.x + b.w / 2 >= o.x AND b.x + b.w / 2 <= o.x + o.w AND b.y + b.h / 2 >= o.y AND b.y + b.h / 2 <= o.y + o.h GROUP BY 1, 2""")
def hidden_boxes(spark, sf):
    """Whether the middle of a box lies under one painted later: whether the latest box over it is another."""
    b = _boxes(spark, sf)
    mid = b.select("g", "id", (F.col("x") + F.col("w") / 2).alias("mx"), (F.col("y") + F.col("h") / 2).alias("my"))
    top = D.latest_over(mid, b, "g")
    return mid.join(top.hint("merge"), ["g", "mx", "my"], "left").select("g", "id", F.coalesce(F.col("latest") > F.col("id"), F.lit(False)).alias("hidden"))


@query(f"""WITH {PTS} SELECT a.id FROM p a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id % 2 = 1 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0001)""")
def invented_corners(spark, sf):
    """Points of one set that no point of the other is near."""
    mine = _points(spark, sf, 0)
    o = _points(spark, sf, 1).select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return mine.select("id").join(D.matched(mine, o, 0.01, []), "id", "left_anti")


@query(f"""WITH RECURSIVE {LABELS}, mn AS (SELECT img_id, label, avg(v) AS m FROM labels_px WHERE label >= 0 GROUP BY 1, 2),
st AS (SELECT a.img_id, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, abs(a.v - b.v) AS step FROM labels_px a JOIN labels_px b ON b.img_id = a.img_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) AND a.label <> b.label WHERE least(a.label, b.label) >= 0),
soft AS (SELECT st.img_id, a, b FROM st JOIN mn p ON p.img_id = st.img_id AND p.label = st.a JOIN mn q ON q.img_id = st.img_id AND q.label = st.b GROUP BY 1, 2, 3 HAVING avg(CAST(step >= abs(p.m - q.m) / 2 AS INTEGER)) <= 0.5),
both_ AS (SELECT img_id, a, b FROM soft UNION SELECT img_id, b, a FROM soft), w AS (SELECT img_id, label, label AS c FROM mn UNION SELECT w.img_id, s.b, w.c FROM w JOIN both_ s ON s.img_id = w.img_id AND s.a = w.label),
k AS (SELECT img_id, label, min(c) AS c FROM w GROUP BY 1, 2) SELECT k.img_id, k.c AS tone, count(*) AS labels_, max(m) - min(m) <= 90 AS fuses FROM k JOIN mn ON mn.img_id = k.img_id AND mn.label = k.label GROUP BY 1, 2""")
def fused_tones(spark, sf):
    """Labels chained by soft pairs, and whether the chain's tones lie close enough to be one."""
    px = labels(spark, sf)
    key = lambda c: (F.col("img_id") * 8 + F.col(c)).alias("id" if c == "a" else "oid")
    means = px.where("label >= 0").groupBy("img_id", "label").agg(F.avg("v").alias("m")).withColumn("id", F.col("img_id") * 8 + F.col("label"))
    pairs = E.soft_pairs(px, 0.5).where("soft").select(key("a"), key("b"))
    tied = D.linked_ids(pairs, means.select("id"), lambda df: written(df, "tones"))
    k = means.join(tied, "id").groupBy("img_id", (F.col("cluster") % 8).cast("int").alias("tone"))
    return k.agg(F.count("*").alias("labels_"), (F.max("m") - F.min("m") <= 90).alias("fuses"))


@query(f"""WITH RECURSIVE {LABELS}, n AS (SELECT a.img_id, a.x, a.y, a.label, list(b.label) AS l FROM labels_px a JOIN labels_px b ON b.img_id = a.img_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY 1, 2, 3, 4),
m AS (SELECT img_id, x, y, label, (SELECT k FROM (SELECT unnest(l) AS k) GROUP BY k ORDER BY count(*) DESC, (k = label) DESC, k LIMIT 1) AS after FROM n),
walk AS (SELECT img_id, x, y, label, y * 65536 + x AS comp FROM labels_px UNION SELECT b.img_id, b.x, b.y, b.label, w.comp FROM walk w JOIN labels_px b ON b.img_id = w.img_id AND b.label = w.label AND abs(b.x - w.x) + abs(b.y - w.y) = 1),
c AS (SELECT img_id, x, y, min(comp) AS comp FROM walk GROUP BY 1, 2, 3)
SELECT c.img_id, CAST(comp AS BIGINT) AS comp, m.label, count(*) AS area, count(*) >= 3 AND count(*) FILTER (WHERE m.after = m.label) <= 0.3 * count(*) AS restored FROM c JOIN m ON m.img_id = c.img_id AND m.x = c.x AND m.y = c.y WHERE m.label >= 0 GROUP BY 1, 2, 3""")
def restored_components(spark, sf):
    """Components of three pixels or more of which a majority filter leaves three tenths or less come back."""
    px = labels(spark, sf).select("img_id", "x", "y", "label", F.col("label").alias("own"))
    # the filtered label comes with its pixel through the components, so that pixels are never joined
    both = K.mode_filter(px).select("img_id", "x", "y", F.col("own").alias("label"), F.col("label").alias("after"))
    c = K.components(both, False, lambda df: written(df, "erased")).where("label >= 0")
    n = F.count("*")
    return c.groupBy("img_id", "comp", "label").agg(n.alias("area"), ((n >= 3) & (F.count_if(F.col("after") == F.col("label")) <= 0.3 * n)).alias("restored"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 10 = 4 THEN value + 1 ELSE value END AS value FROM events")
def json_lines_round_trip(spark, sf):
    """Rows written as JSON lines, some of them twice with a newer value last, some lines broken, and
    read back: broken lines go, and of several lines with one key the last stays."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    text = lambda value: F.to_json(F.struct("event_id", "user_id", value.alias("value")))
    again = F.when(F.col("event_id") % 10 == 4, text(F.col("value") + 1))
    broken = F.when(F.col("event_id") % 10 == 7, F.lit('{"event_id": 3, "val'))
    lines = e.select(F.explode(F.array_compact(F.array(text(F.col("value")), broken, again))).alias("value"))
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex[:12]}"
    lines.write.text(path)
    return json_lines(spark, path, "event_id long, user_id long, value double", "event_id")
