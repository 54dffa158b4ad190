"""Segmentation steps over label maps: soft pairs, despeckling, skeleton graphs, smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import grid
from .raster import below, right, with_cross


def boundary_steps(px: DataFrame) -> DataFrame:
    """(img_id, a, b, step): level steps between neighbours of different opaque labels, a < b."""
    px = px.withColumns({"rl": right("label"), "rv": right("v"), "dl": below("label"), "dv": below("v")})
    pair = lambda l, v: F.when(F.col(l) != F.col("label"), F.struct(F.least(l, "label").alias("a"), F.greatest(l, "label").alias("b"), F.abs(F.col(v) - F.col("v")).alias("step")))
    steps = px.select("img_id", F.explode(F.array_compact(F.array(pair("rl", "rv"), pair("dl", "dv")))).alias("s"))
    return steps.select("img_id", "s.*").where("a >= 0")


def soft_pairs(px: DataFrame, share: float = 0.25) -> DataFrame:
    """Pairs of labels of which few boundary steps reach half the distance of their mean levels."""
    means = px.where("label >= 0").groupBy("img_id", "label").agg(F.avg("v").alias("m"))
    near = boundary_steps(px)
    a = means.select("img_id", F.col("label").alias("a"), F.col("m").alias("ma"))
    b = means.select("img_id", F.col("label").alias("b"), F.col("m").alias("mb"))
    near = near.join(a, ["img_id", "a"]).join(b, ["img_id", "b"])
    hard = F.avg((F.col("step") >= F.abs(F.col("ma") - F.col("mb")) / 2).cast("double"))
    return near.groupBy("img_id", "a", "b").agg(hard.alias("hard"), F.count("*").alias("steps")).withColumn("soft", F.col("hard") <= share)


def despeckled(px: DataFrame, regions: DataFrame, least_area: int) -> DataFrame:
    """Regions (a pixel's ``comp``) under the area take the label of most of their border's outer
    neighbours, the lowest of several; regions without any stay."""
    # tables of this kind grow with the pixels: merged, never broadcast, whatever the planner makes of their size
    both = with_cross(px.join(regions.select("img_id", "x", "y", "comp").hint("merge"), ["img_id", "x", "y"]), "label")
    area = both.groupBy("img_id", "comp").agg(F.count("*").alias("area"))
    outer = both.select("img_id", "comp", "label", F.explode(F.array("l", "r", "u", "d")).alias("o")).where("o is not null and o <> label")
    votes = outer.groupBy("img_id", "comp", "o").agg(F.count("*").alias("n"))
    best = votes.groupBy("img_id", "comp").agg(F.max(F.struct(F.col("n"), (-F.col("o")).alias("low"))).alias("b"))
    joined = both.join(area.hint("merge"), ["img_id", "comp"]).join(best.hint("merge"), ["img_id", "comp"], "left")
    new = F.when((F.col("area") < least_area) & F.col("b").isNotNull(), -F.col("b.low")).otherwise(F.col("label"))
    return joined.select("img_id", "x", "y", new.cast("int").alias("label"))


def skeleton_degrees(px: DataFrame) -> DataFrame:
    """Neighbours, of eight, that each skeleton pixel has: 1 ends a chain, 3 or more join chains."""
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]))
    moved = px.select("img_id", "x", "y", around.alias("d")).select("img_id", "x", "y", (F.col("x") + F.col("d.dx")).alias("nx"), (F.col("y") + F.col("d.dy")).alias("ny"))
    other = px.select("img_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.lit(1).alias("one"))
    return moved.join(other, ["img_id", "nx", "ny"], "left").groupBy("img_id", "x", "y").agg(F.count("one").alias("degree"))


def smooth_with_steps(levels: np.ndarray, weight: float, step: float, rounds: int) -> np.ndarray:
    """Smoothing that stops at steps: sweeps in place, forwards and backwards by turns, each pixel
    to the weighted mean of itself and the neighbours that differ by less than ``step``."""
    u, h, w = levels.astype(float).copy(), *levels.shape
    order = [(y, x) for y in range(h) for x in range(w)]
    for k in range(rounds):
        for y, x in order if k % 2 == 0 else reversed(order):
            total, n = levels[y, x], 1.0
            for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= ny < h and 0 <= nx < w and abs(u[ny, nx] - u[y, x]) < step:
                    total += weight * u[ny, nx]
                    n += weight
            u[y, x] = total / n
    return u


def smoothed(px: DataFrame, weight: float = 1.0, step: float = 48.0, rounds: int = 4) -> DataFrame:
    """Sweeps in place depend on their order, so an image is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = smooth_with_steps(grid(pdf, "v"), weight, step, rounds)
        y, x = np.indices(u.shape)
        return pd.DataFrame({"img_id": int(pdf["img_id"].iloc[0]), "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "u": u.ravel()})

    return px.select("img_id", "x", "y", "v").groupBy("img_id").applyInPandas(run, "img_id long, x int, y int, u double")


def _lloyd(v: np.ndarray, n: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, count) of up to ``k`` centres for each histogram of a stack: levels ``v`` ascending, counts
    ``n``, zero beyond a histogram's end. A centre that is not there has a count of zero."""
    whole = n.sum(axis=1, keepdims=True)
    share = (np.cumsum(n, axis=1) - n / 2) / whole
    last = (n > 0).sum(axis=1) - 1
    each = np.arange(len(v))
    centres = np.empty((len(v), k))
    for i in range(k):
        enough = (share >= (i + 0.5) / k) & (n > 0)
        centres[:, i] = v[each, np.where(enough.any(axis=1), enough.argmax(axis=1), last)]
    # centres ascend; one that comes again goes
    centres[:, 1:][centres[:, 1:] == centres[:, :-1]] = np.inf
    for _ in range(rounds + 1):
        away, own = np.full(v.shape, np.inf), np.zeros(v.shape, dtype=np.int64)
        for i in range(k):
            d = np.abs(v - centres[:, i : i + 1])
            nearer = d < away
            away, own = np.where(nearer, d, away), np.where(nearer, i, own)
        count = np.stack([np.where(own == i, n, 0).sum(axis=1) for i in range(k)], axis=1)
        total = np.stack([np.where(own == i, n * v, 0).sum(axis=1) for i in range(k)], axis=1)
        was = centres
        centres = np.where(count > 0, total / np.where(count > 0, count, 1), np.inf)
    return was, count


#: Histograms that are taken at once.
HISTOGRAMS = 2048


def weighted_palette(px: DataFrame, k: int, rounds: int) -> DataFrame:
    """Per image at most ``k`` levels by weighted Lloyd rounds over its histogram, from the levels
    at even shares of the weight; (img_id, entry, level, count), by count. A histogram has as many
    entries as there are levels, so it is one row and many are taken at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in (whole.slice(s, HISTOGRAMS) for s in range(0, whole.num_rows, HISTOGRAMS)):
                h = batch.column("h")
                size, flat = h.value_lengths().to_numpy(zero_copy_only=False), h.flatten()
                row, col = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                v, n = np.zeros((len(size), size.max())), np.zeros((len(size), size.max()))
                v[row, col], n[row, col] = flat.field("v").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
                level, count = _lloyd(v, n, k, rounds)
                order = np.lexsort((level, -count), axis=1)
                level, count = np.take_along_axis(level, order, axis=1), np.take_along_axis(count, order, axis=1)
                image, entry = np.nonzero(count > 0)
                columns = [batch.column("img_id").take(pa.array(image)), pa.array(entry), pa.array(level[image, entry]), pa.array(count[image, entry].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["img_id", "entry", "level", "count"])

    counts = px.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("v").cast("double").alias("v"), F.col("n").cast("double").alias("n"))
    h = counts.where("v is not null").groupBy(F.col("img_id").cast("long").alias("img_id")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    return h.mapInArrow(run, "img_id long, entry long, level double, count long")
