"""Raster kernels as joins, windows and aggregates over pixel tables (img_id, x, y, ...).

Neighbours come by windows along rows and columns of one image, so an image is shuffled once and
never joined with itself; only iteration over regions (``components``) joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import regions


def row():
    """Windows are made on use: they need a session."""
    return Window.partitionBy("img_id", "y").orderBy("x")


def column():
    return Window.partitionBy("img_id", "x").orderBy("y")


def left(c: str) -> Column:
    return F.lag(c).over(row())


def right(c: str) -> Column:
    return F.lead(c).over(row())


def above(c: str) -> Column:
    return F.lag(c).over(column())


def below(c: str) -> Column:
    return F.lead(c).over(column())


def with_cross(px: DataFrame, c: str) -> DataFrame:
    """Adds l, r, u, d: the four neighbours' values, null at the border."""
    return px.withColumns({"l": left(c), "r": right(c)}).withColumns({"u": above(c), "d": below(c)})


def with_block(px: DataFrame, c: str) -> DataFrame:
    """Adds ``block``: the values of the 3 by 3 block, rows from the top; fewer at the border."""
    px = px.withColumn("__row", F.collect_list(c).over(row().rowsBetween(-1, 1)))
    return px.withColumn("block", F.flatten(F.collect_list("__row").over(column().rowsBetween(-1, 1)))).drop("__row")


def palette(px: DataFrame, colour: list[str]) -> DataFrame:
    return px.groupBy("img_id", *colour).agg(F.count("*").alias("count"))


def flat_interior(px: DataFrame) -> DataFrame:
    """Per label the pixels whose whole 3 by 3 block has the label."""
    same = (F.size("block") == 9) & (F.array_size(F.array_distinct("block")) == 1)
    return with_block(px, "label").groupBy("img_id", "label").agg(F.count_if(same).alias("flat"), F.count("*").alias("count"))


def edge_share(px: DataFrame) -> DataFrame:
    """Per label the share of pixels with a different neighbour; the border does not count."""
    differs = reduce(Column.__or__, [F.coalesce(F.col(n) != F.col("label"), F.lit(False)) for n in "lrud"])
    return with_cross(px, "label").where("label >= 0").groupBy("img_id", "label").agg(F.avg(differs.cast("double")).alias("share"))


def border_background(px: DataFrame, size: int) -> DataFrame:
    """Per image the most frequent label on the outer ring, the lowest of several, -1 unless half of
    the ring is opaque."""
    ring = px.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == size - 1) | (F.col("y") == size - 1))
    n = ring.groupBy("img_id", "label").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("label") >= 0, F.struct(F.col("n"), (-F.col("label")).alias("low"))))
    opaque = F.sum(F.when(F.col("label") >= 0, F.col("n")).otherwise(0)) >= F.sum("n") / 2
    t = n.groupBy("img_id").agg(best.alias("b"), opaque.alias("opaque"))
    return t.select("img_id", F.when(F.col("opaque"), -F.col("b.low")).otherwise(-1).alias("background"))


def mode_filter(px: DataFrame, passes: int = 1) -> DataFrame:
    """Majority of the 3 by 3 block; the centre stays on a tie with it, else the lowest label wins.
    A pass reads the labels from before it."""
    for _ in range(passes):
        px = with_block(px, "label")
        kinds = F.array_sort(F.array_distinct("block"))
        counts = F.transform(kinds, lambda k: F.struct(F.size(F.filter("block", lambda b: b == k)).alias("n"), (k == F.col("label")).alias("own"), (-k).alias("low")))
        px = px.withColumn("label", (-F.array_max(counts)["low"]).cast("int")).drop("block")
    return px


def box_blur(px: DataFrame, value: str, radius: int) -> DataFrame:
    across = F.avg(value).over(row().rowsBetween(-radius, radius))
    px = px.withColumn("__b", across)
    return px.withColumn("blur", F.avg("__b").over(column().rowsBetween(-radius, radius))).drop("__b")


def dilate(px: DataFrame, value: str, radius: int, erode: bool = False) -> DataFrame:
    f = F.min if erode else F.max
    px = px.withColumn("__m", f(value).over(row().rowsBetween(-radius, radius)))
    return px.withColumn("out", f("__m").over(column().rowsBetween(-radius, radius))).drop("__m")


def edge_mask(px: DataFrame, value: str, limit: float) -> DataFrame:
    steps = [F.coalesce(F.abs(F.col(n) - F.col(value)), F.lit(0)) for n in "lrud"]
    return with_cross(px, value).withColumn("edge", F.greatest(*steps) >= limit).drop(*"lrud")


def cracks(px: DataFrame) -> DataFrame:
    """Boundary steps between pixels of different labels, as corner pairs; the outside is -1."""
    px = px.withColumns({"l": F.coalesce(left("label"), F.lit(-1)), "u": F.coalesce(above("label"), F.lit(-1))}).withColumns(
        {"last_x": right("label").isNull(), "last_y": below("label").isNull()}
    )
    side = lambda ok, x0, y0, x1, y1, a, b: F.when(ok, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), a.alias("a"), b.alias("b")))
    x, y, v, out = F.col("x"), F.col("y"), F.col("label"), F.lit(-1)
    found = F.array(
        side(F.col("l") != v, x, y, x, y + 1, F.col("l"), v),
        side(F.col("u") != v, x, y, x + 1, y, F.col("u"), v),
        side(F.col("last_x") & (v != -1), x + 1, y, x + 1, y + 1, v, out),
        side(F.col("last_y") & (v != -1), x, y + 1, x + 1, y + 1, v, out),
    )
    return px.select("img_id", F.explode(F.array_compact(found)).alias("e")).select("img_id", "e.*")


def junctions(edges: DataFrame) -> DataFrame:
    """Corners where three boundary steps or more meet."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    corner = edges.select("img_id", ends.alias("p")).groupBy("img_id", "p.x", "p.y").agg(F.count("*").alias("degree"))
    return corner.where("degree >= 3")


def downscale(px: DataFrame, value: str, k: int) -> DataFrame:
    return px.groupBy("img_id", F.floor(F.col("x") / k).cast("int").alias("x"), F.floor(F.col("y") / k).cast("int").alias("y")).agg(F.avg(value).alias("v"))


def rampiness(px: DataFrame, value: str, small: int, large: int) -> DataFrame:
    """Per image how many steps to the right neighbour are flat, ramps or edges."""
    step = F.abs(right(value) - F.col(value))
    return px.withColumn("step", step).where("step is not null").groupBy("img_id").agg(
        F.count_if(F.col("step") < small).alias("flat"),
        F.count_if((F.col("step") >= small) & (F.col("step") < large)).alias("ramp"),
        F.count_if(F.col("step") >= large).alias("edge"),
    )


def ssim(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Per image the mean structural similarity of two levels over whole windows of that radius."""
    both = a.select("img_id", "x", "y", F.col("v").cast("double").alias("a")).join(b.select("img_id", "x", "y", F.col("v").cast("double").alias("b")), ["img_id", "x", "y"])
    both = both.withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    names = ["a", "b", "aa", "bb", "ab"]
    both = both.withColumns({f"s{c}": F.sum(c).over(row().rowsBetween(-radius, radius)) for c in names} | {"nx": F.count("a").over(row().rowsBetween(-radius, radius))})
    both = both.withColumns(
        {f"m{c}": F.sum(f"s{c}").over(column().rowsBetween(-radius, radius)) / (2 * radius + 1) ** 2 for c in names}
        | {"n": F.sum("nx").over(column().rowsBetween(-radius, radius))}
    )
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("maa") - ma * ma, F.col("mbb") - mb * mb, F.col("mab") - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return both.where(F.col("n") == (2 * radius + 1) ** 2).groupBy("img_id").agg(F.avg(s).alias("ssim"))


def components(px: DataFrame, eight: bool, checkpoint) -> DataFrame:
    """Connected regions of equal label: each pixel gets the least pixel number of its region."""
    return regions(px, eight, checkpoint)
