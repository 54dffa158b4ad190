"""Queries of regions and floods over whole sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as K
from ..operators import tiles as T
from ..sources.roles import SHEETS, sheet_labels
from ..sources.scratch import written
from .registry import query

#: Components of fewer pixels are dissolved.
LEAST = 4


@query(f"""WITH RECURSIVE {SHEETS}, walk AS (SELECT img_id, x, y, label, y * 65536 + x AS comp FROM sheet
 UNION SELECT b.img_id, b.x, b.y, b.label, w.comp FROM walk w JOIN sheet b ON b.img_id = w.img_id AND b.label = w.label AND abs(b.x - w.x) + abs(b.y - w.y) = 1),
c AS (SELECT img_id, x, y, label, min(comp) AS comp FROM walk GROUP BY 1, 2, 3, 4)
SELECT img_id, CAST(comp AS BIGINT) AS comp, label, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY 1, 2, 3""")
def sheet_regions(spark, sf):
    """Connected regions of whole sheets, found in tiles of 16 pixels and joined at the borders."""
    c = T.regions(sheet_labels(spark, sf).select("img_id", "x", "y", "label"), False, lambda df: written(df, "sheet-regions"), size=16)
    return c.groupBy("img_id", "comp", "label").agg(F.count("*").alias("area"), *[f(c).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))])


@query()
def grown_regions(spark, sf):
    """Components of fewer than four pixels are dissolved: the regions around grow into them from the
    rim, lowest cost first. A pixel's cost for a region is the squared difference of its 3 by 3 mean
    from the mean tone of the region's label; a component that no region reaches keeps its label."""
    px = sheet_labels(spark, sf)
    c = K.components(px.where("label >= 0"), False, lambda df: written(df, "grown"))
    area = c.groupBy("img_id", "comp").agg(F.count("*").alias("n"))
    tone = px.where("label >= 0").groupBy("img_id", "label").agg(F.avg("v").alias("tone"))
    kept = F.when(F.col("n") >= LEAST, F.struct("label", "tone"))
    rows = c.join(area, ["img_id", "comp"]).join(tone, ["img_id", "label"]).withColumn("own", kept)
    mean = K.with_block(px, "v").select("img_id", "x", "y", (F.aggregate("block", F.lit(0), lambda a, b: a + b) / F.size("block")).alias("mean"))
    around = px.select("img_id", "x", "y").join(rows.drop("v"), ["img_id", "x", "y"], "left").join(mean, ["img_id", "x", "y"])
    holes = K.with_cross(around, "own").where(f"n < {LEAST}")
    grown = T.grown(holes.select("img_id", "comp", "x", "y", F.col("mean").alias("v"), F.array_distinct(F.array_compact(F.array(*"lrud"))).alias("rim")))
    out = holes.select("img_id", "x", "y", F.col("label").alias("before")).join(grown.drop("comp"), ["img_id", "x", "y"], "left")
    return out.select("img_id", "x", "y", "before", F.coalesce("label", "before").alias("label"))


def marks(sheets):
    """Nine marks for each sheet, at sixths of its width and height."""
    at = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("mark")
    m = sheets.select("img_id").distinct().select("img_id", at)
    place = lambda k: F.floor((1 + 2 * k) * 64 / 6).cast("int")
    return m.select("img_id", "mark", place(F.col("mark") % 3).alias("mx"), place(F.floor(F.col("mark") / 3)).alias("my"))


@query(f"""WITH {SHEETS}, nb AS (SELECT *, lag(label) OVER r AS l, lead(label) OVER r AS n, lag(label) OVER c AS u, lead(label) OVER c AS d FROM sheet
  WINDOW r AS (PARTITION BY img_id, y ORDER BY x), c AS (PARTITION BY img_id, x ORDER BY y)),
smooth AS (SELECT img_id, x, y FROM nb WHERE label >= 0 AND coalesce(l, label) = label AND coalesce(n, label) = label AND coalesce(u, label) = label AND coalesce(d, label) = label),
m AS (SELECT img_id, mark, CAST(floor((1 + 2 * (mark % 3)) * 64 / 6) AS INTEGER) AS mx, CAST(floor((1 + 2 * (mark // 3)) * 64 / 6) AS INTEGER) AS my FROM (SELECT DISTINCT img_id FROM sheet), range(9) t(mark)),
far AS (SELECT m.*, x, y, greatest(abs(x - mx), abs(y - my)) AS far, abs(y - my) = greatest(abs(x - mx), abs(y - my)) AS level FROM m JOIN smooth s ON s.img_id = m.img_id AND abs(x - mx) <= 8 AND abs(y - my) <= 8)
SELECT img_id, CAST(mark AS INTEGER) AS mark, x, y FROM far
QUALIFY row_number() OVER (PARTITION BY img_id, mark ORDER BY far, NOT level, CASE WHEN level THEN x - mx ELSE y - my END, CASE WHEN level THEN y - my ELSE x - mx END) = 1""")
def snapped_marks(spark, sf):
    """Marks on a sheet moved to the nearest pixel whose neighbours all have its label."""
    px = sheet_labels(spark, sf)
    same = lambda c: F.coalesce(F.col(c) == F.col("label"), F.lit(True))
    smooth = K.with_cross(px, "label").where((F.col("label") >= 0) & same("l") & same("r") & same("u") & same("d")).select("img_id", "x", "y")
    return T.snapped(marks(px), smooth, 8)


@query()
def marker_split(spark, sf):
    """Regions of opaque pixels that hold two marks or more are split among them: each mark floods its
    region from its snapped pixel, over the lowest steps first, so that parts meet on ridges; a
    pixel's cost is the range of its 3 by 3 block. A region's first mark keeps its number, the others'
    parts get numbers below zero."""
    px = sheet_labels(spark, sf, levels=1)
    c = K.components(px.where("label >= 0"), False, lambda df: written(df, "marker-regions"))
    at = written(snapped_marks(spark, sf).groupBy("img_id", "x", "y").agg(F.min("mark").alias("mark")), "marks")
    seeds = at.join(c, ["img_id", "x", "y"]).select("img_id", "x", "y", "mark", "comp")
    split = seeds.groupBy("img_id", "comp").agg(F.count("*").alias("n"), F.min("mark").alias("first")).where("n >= 2")
    steep = K.with_block(px, "v").select("img_id", "x", "y", (F.array_max("block") - F.array_min("block")).alias("cost"))
    rows = c.join(split, ["img_id", "comp"]).join(steep, ["img_id", "x", "y"]).join(at, ["img_id", "x", "y"], "left")
    flood = T.flooded(rows.select("img_id", "x", "y", F.col("comp").alias("area"), "cost", F.coalesce("mark", F.lit(-1)).alias("seed")), lambda df: written(df, "marker-flood"), size=32)
    first = split.select("img_id", F.col("comp").alias("area"), "first")
    part = F.when(F.col("label") == F.col("first"), F.col("area")).otherwise(-1 - F.col("label"))
    return flood.join(first, ["img_id", "area"]).groupBy("img_id", F.col("area").alias("region"), part.alias("part"), F.col("label").alias("mark")).agg(F.count("*").alias("size"), F.max("level").alias("level"))
