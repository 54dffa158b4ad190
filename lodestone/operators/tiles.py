"""Work that spreads over an image, tile by tile: connected regions and floods from several seeds.

A tile is one group of bounded size, so a large image takes many tasks. What crosses a border is
settled by joins over border pixels alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import linked_ids

TILE = 256


def _tile(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def least_of_region(label: np.ndarray, there: np.ndarray, eight: bool) -> np.ndarray:
    """For each cell of a grid the number of the first cell of its region. Roots hook onto smaller
    ones and paths are cut short, until no two neighbours of one label have different roots."""
    at = np.arange(label.size).reshape(label.shape)
    shifts = [((slice(None), slice(0, -1)), (slice(None), slice(1, None))), ((slice(0, -1), slice(None)), (slice(1, None), slice(None)))]
    if eight:
        shifts += [((slice(0, -1), slice(0, -1)), (slice(1, None), slice(1, None))), ((slice(0, -1), slice(1, None)), (slice(1, None), slice(0, -1)))]
    a, b = (np.concatenate([at[s[k]][(label[s[0]] == label[s[1]]) & there[s[0]] & there[s[1]]] for s in shifts]) for k in (0, 1))
    root = at.reshape(-1).copy()
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root.reshape(label.shape)
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while True:
            on = root[root]
            if (on == root).all():
                break
            root = on


def regions(px: DataFrame, eight: bool, checkpoint, size: int = TILE) -> DataFrame:
    """Connected regions of equal label: each pixel gets ``comp``, the least pixel number
    (65,536 y + x) of its region. Regions are found within tiles; those that touch across a border
    with one label are linked. A null label is a label of its own."""
    names = px.columns

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = x.min(), y.min()
        shape = (int(y.max() - y0) + 1, int(x.max() - x0) + 1)
        label, there = np.zeros(shape, np.int64), np.zeros(shape, bool)
        label[y - y0, x - x0] = pd.factorize(pdf["label"], use_na_sentinel=False)[0]
        there[y - y0, x - x0] = True
        root = least_of_region(label, there, eight)[y - y0, x - x0]
        return pdf[names].assign(comp=((root // shape[1] + y0) * 65_536 + root % shape[1] + x0).astype("int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema) + ", comp long"
    tiled = px.withColumns({"__tx": _tile("x", size), "__ty": _tile("y", size)})
    local = checkpoint(tiled.groupBy("img_id", "__tx", "__ty").applyInPandas(within, schema))
    # a tile's region is known by its image and its least pixel
    node = ((F.col("img_id") * 4_294_967_296) + F.col("comp")).cast("long")
    last, first = size - 1, 0
    border = local.where((F.col("x") % size).isin(first, last) | (F.col("y") % size).isin(first, last)).select("img_id", "x", "y", "label", node.alias("id"))
    reach = [-1, 0, 1] if eight else [0]
    step = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    right = F.when(F.col("x") % size == last, F.array(*[step(1, d) for d in reach])).otherwise(F.array())
    down = F.when(F.col("y") % size == last, F.array(*[step(d, 1) for d in reach])).otherwise(F.array())
    back = F.when(F.col("x") % size == first, F.array(step(-1, 1))).otherwise(F.array()) if eight else F.array()
    near = border.select("img_id", "label", "id", F.explode(F.concat(right, down, back)).alias("n")).select("img_id", "label", "id", "n.x", "n.y")
    other = border.select("img_id", "x", "y", F.col("label").alias("other"), F.col("id").alias("oid"))
    pairs = checkpoint(near.join(other, ["img_id", "x", "y"]).where(F.col("label").eqNullSafe(F.col("other")) & (F.col("id") != F.col("oid"))).select("id", "oid").distinct())
    if pairs.isEmpty():
        return local
    nodes = pairs.select("id").union(pairs.select("oid")).distinct()
    tied = linked_ids(pairs, nodes, checkpoint).select(F.col("id").alias("__id"), F.pmod("cluster", F.lit(4_294_967_296)).alias("__first"))
    joined = local.withColumn("__id", node).join(tied, "__id", "left")
    return joined.select(*names, F.coalesce("__first", "comp").alias("comp"))


FLOODED = ("img_id", "x", "y", "area", "cost", "seed", "label", "level", "hops")


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile: the claims that its own seeds and its neighbours' border pixels lead to. The least
    claim of all that wait is taken first."""
    own = pdf[~pdf["halo"]].reset_index(drop=True)
    area, cost, seed, xs, ys = (own[c].tolist() for c in ("area", "cost", "seed", "x", "y"))
    place = {p: k for k, p in enumerate(zip(xs, ys, strict=True))}
    taken: list[tuple | None] = [(0, 0, s) if s >= 0 else None for s in seed]
    heap: list[tuple] = []

    def offer(x: int, y: int, region: int, level: int, hops: int, by: int) -> None:
        for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            k = place.get(p)
            if k is not None and taken[k] is None and area[k] == region:
                heapq.heappush(heap, (max(level, cost[k]), hops + 1 if cost[k] <= level else 0, by, k))

    for r in pdf[pdf["halo"]].itertuples():
        offer(r.x, r.y, r.area, r.level, r.hops, r.label)
    for k, s in enumerate(seed):
        if s >= 0:
            offer(xs[k], ys[k], area[k], 0, 0, s)
    while heap:
        level, hops, by, k = heapq.heappop(heap)
        if taken[k] is None:
            taken[k] = (level, hops, by)
            offer(xs[k], ys[k], area[k], level, hops, by)
    out = np.array([t if t is not None else (-1, -1, -1) for t in taken], dtype="int64").reshape(-1, 3)
    return own.assign(level=out[:, 0], hops=out[:, 1], label=out[:, 2])[list(FLOODED)]


def flooded(px: DataFrame, checkpoint, size: int = TILE, most_rounds: int = 500, most: int = TILE) -> DataFrame:
    """A flood from several seeds, lowest cost first, within areas.

    ``px``: (img_id, x, y, area, cost, seed). A pixel with ``seed`` of 0 or more starts with that
    label; others are open. A claim on an open pixel has a level, the highest cost on its way, and
    hops, the steps since it came to that level; the least claim by (level, hops, label) wins, so
    arrival decides among equals. Claims pass between the four neighbours of one ``area``. Returns px
    with label (-1: not reached), level and hops.

    Each tile is flooded on its own, given the claims on its neighbours' borders; rounds go on until
    no claim changes. Levels and hops only fall from round to round and a claim is greater than what
    it came from, so that end is the same as one flood of the whole image. Tiles start with ``size`` and
    are twice as wide in each round, up to ``most``, as long as claims cross their borders: an image that fits
    into one tile is then done at once, where tiles of one size would hand claims to and fro."""
    now = px.select(*[F.col(c).cast("long").alias(c) for c in FLOODED[:6]]).withColumns({c: F.lit(-1).cast("long") for c in FLOODED[6:]})
    schema = ", ".join(f"{c} long" for c in FLOODED)
    x, y, mark, most = F.col("x"), F.col("y"), None, max(size, most)
    for k in range(most_rounds):
        edges = ((x, 0, -1, 0), (x, size - 1, 1, 0), (y, 0, 0, -1), (y, size - 1, 0, 1))
        to = [F.when(at % size == edge, F.struct((_tile("x", size) + dx).alias("tx"), (_tile("y", size) + dy).alias("ty"))) for at, edge, dx, dy in edges]
        tile = now.withColumns({"halo": F.lit(False), "tx": _tile("x", size), "ty": _tile("y", size)})
        if k:
            halo = now.where("label >= 0").withColumn("to", F.explode(F.array_compact(F.array(*to)))).select(*now.columns, F.lit(True).alias("halo"), "to.tx", "to.ty")
            tile = tile.unionByName(halo)
        now = checkpoint(tile.groupBy("img_id", "tx", "ty").applyInPandas(_spread, schema))
        if now.select("img_id", _tile("x", size), _tile("y", size)).distinct().groupBy("img_id").count().where("count > 1").isEmpty():
            return now
        found = now.agg(F.bit_xor(F.xxhash64("img_id", "x", "y", "label", "level", "hops"))).first()[0]
        if found == mark:
            return now
        mark, size = found, min(2 * size, most)
    raise RuntimeError(f"claims still change after {most_rounds} rounds")


def grown(holes: DataFrame) -> DataFrame:
    """Seeded growth into small regions: (img_id, comp, x, y, label) for the pixels that a neighbour's
    label reaches.

    ``holes``: (img_id, comp, x, y, v, rim), the pixels of the regions to fill, where ``rim`` lists
    (label, tone) of the labels beside a pixel. A pixel's cost for a label is the squared difference
    of v from its tone. Pixels are claimed from the rim inward, the least (cost, pixel, label) of all
    that wait first. Regions are small, or they would not be filled; those that begin in one tile are
    one group."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        v = {(x, y): (t, c) for x, y, t, c in zip(pdf["x"], pdf["y"], pdf["v"], pdf["comp"], strict=True)}
        heap = [((v[x, y][0] - r["tone"]) ** 2, y, x, r["label"], r["tone"]) for x, y, rim in zip(pdf["x"], pdf["y"], pdf["rim"], strict=True) for r in rim]
        heapq.heapify(heap)
        out: dict[tuple[int, int], int] = {}
        while heap:
            _, y, x, label, tone = heapq.heappop(heap)
            if (x, y) not in out:
                out[x, y] = label
                for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                    if p in v and p not in out and v[p][1] == v[x, y][1]:
                        heapq.heappush(heap, ((v[p][0] - tone) ** 2, p[1], p[0], label, tone))
        rows = [(pdf["img_id"].iloc[0], v[p][1], *p, label) for p, label in out.items()]
        return pd.DataFrame(rows, columns=["img_id", "comp", "x", "y", "label"])

    tile = [F.floor(F.col("comp") % 65_536 / TILE).alias("tx"), F.floor(F.col("comp") / 65_536 / TILE).alias("ty")]
    return holes.groupBy("img_id", *tile).applyInPandas(fill, "img_id long, comp long, x int, y int, label int")


def snapped(marks: DataFrame, smooth: DataFrame, reach: int) -> DataFrame:
    """Marks (img_id, mark, mx, my) moved to the nearest smooth pixel (img_id, x, y) by the larger of
    the two steps, no more than ``reach`` away; marks without one go. Of several the rows above and
    below come first, from the left and the upper one first, then the columns from the top."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    m = marks.withColumn("cx", around).withColumn("cy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    m = m.withColumns({"cx": cell("mx") + F.col("cx"), "cy": cell("my") + F.col("cy")})
    near = m.join(smooth.withColumns({"cx": cell("x"), "cy": cell("y")}), ["img_id", "cx", "cy"])
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    far = F.greatest(F.abs(dx), F.abs(dy))
    level = F.abs(dy) == far
    order = F.struct(far.alias("far"), (~level).alias("side"), F.when(level, dx).otherwise(dy).alias("along"), F.when(level, dy).otherwise(dx).alias("across"), "x", "y")
    best = near.where(far <= reach).groupBy("img_id", "mark").agg(F.min(order).alias("m"))
    return best.select("img_id", "mark", "m.x", "m.y")
