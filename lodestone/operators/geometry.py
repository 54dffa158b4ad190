"""Work that is sequential within one image or chain: grouped Arrow-batched functions.

Groups are single images or single chains; Spark spreads them over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(pdf: pd.DataFrame, value: str, fill: int = 0) -> np.ndarray:
    out = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), fill)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[value].to_numpy()
    return out


def squared_distances(ink: np.ndarray) -> np.ndarray:
    """Exact squared distance of each pixel to the nearest pixel without ink: column distances
    first, then the least over each row of parabolas. Infinite where every pixel has ink."""
    h, w = ink.shape
    far = np.full(w, np.inf)
    down = np.empty((h, w))
    for y in range(h):
        far = np.where(ink[y] == 0, 0, far + 1)
        down[y] = far
    far = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        far = np.where(ink[y] == 0, 0, far + 1)
        down[y] = np.minimum(down[y], far)
    offset = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.stack([(down[y][None, :] ** 2 + offset).min(axis=1) for y in range(h)])


def distance_transform(px: DataFrame) -> DataFrame:
    """(img_id, x, y, d) for ink pixels of images that have others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ink = grid(pdf, "ink")
        d = np.sqrt(squared_distances(ink))
        y, x = np.nonzero((ink == 1) & np.isfinite(d))
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[0], "x": x.astype("int32"), "y": y.astype("int32"), "d": d[y, x]})

    return px.select("img_id", "x", "y", "ink").groupBy("img_id").applyInPandas(run, "img_id long, x int, y int, d double")


def thin(ink: np.ndarray) -> np.ndarray:
    """Thinning in two alternating sub-passes until neither removes a pixel. A pixel goes if it has
    two to six neighbours, one run of them around it, and the sub-pass's two triples have a gap."""
    a = np.pad(ink.astype(bool), 1)
    changed = True
    while changed:
        changed = False
        for odd in (False, True):
            n = [np.roll(a, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = np.sum(n, axis=0)
            runs = np.sum([~n[i] & n[(i + 1) % 8] for i in range(8)], axis=0)
            north, east, south, west = n[0], n[2], n[4], n[6]
            gap = ~(north & east & west) & ~(north & south & west) if odd else ~(north & east & south) & ~(east & south & west)
            gone = a & (count >= 2) & (count <= 6) & (runs == 1) & gap
            a = a & ~gone
            changed |= bool(gone.any())
    return a[1:-1, 1:-1]


def thinned(px: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = np.nonzero(thin(grid(pdf, "ink")))
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[0], "x": x.astype("int32"), "y": y.astype("int32")})

    return px.select("img_id", "x", "y", "ink").groupBy("img_id").applyInPandas(run, "img_id long, x int, y int")


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed boundary loops of a mask as corner points, the inside to the right of each step; at a
    corner with two ways on, the turn that keeps diagonal pixels apart is taken."""
    m = np.pad(mask, 1)
    high = m.shape[0] + 1
    y, x = np.nonzero(m)
    # corners are numbers x * high + y, in the order of (x, y)
    corner = [x * high + y, (x + 1) * high + y, (x + 1) * high + y + 1, x * high + y + 1]
    outside = ~np.stack([m[y - 1, x], m[y, x + 1], m[y + 1, x], m[y, x - 1]], axis=1)
    a, b = (np.stack([corner[(k + side) % 4] for k in range(4)], axis=1)[outside].tolist() for side in (0, 1))
    steps: dict[int, list[int]] = {}
    for p, q in zip(a, b, strict=True):
        steps.setdefault(p, []).append(q)
    loops = []
    for start in sorted(steps):
        while start in steps:
            at, loop, before = start, [], None
            while True:
                ways = steps[at]
                if len(ways) > 1:
                    if before is not None:
                        dx, dy = at // high - before // high, at % high - before % high
                        ways.sort(key=lambda p: dx * (p % high - at % high) - dy * (p // high - at // high))  # noqa: B023
                    after = ways.pop()
                else:
                    after = steps.pop(at)[0]
                loop.append((at // high - 1, at % high - 1))
                before, at = at, after
                if at == start:
                    break
            loops.append(loop)
    return loops


def signed_area(loop: np.ndarray) -> float:
    x, y = loop[:, 0], loop[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def loop_area(loop: list[tuple[float, float]]) -> float:
    """``signed_area`` of a list of points, which takes less time for short loops."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(loop, [*loop[1:], loop[0]], strict=True)) / 2


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a chain that stay: split at the farthest point while it is over the tolerance."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        rest = points[a + 1 : b] - points[a]
        size = np.hypot(*chord)
        away = np.hypot(*rest.T) if size == 0 else np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / size
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


#: Chains up to this length are split by a loop, which takes less time there.
SHORT = 48


def _simplified_corners(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """``simplified`` for points of whole numbers, whose products are exact."""
    keep = bytearray(len(points))
    keep[0] = keep[-1] = 1
    stack, whole = [(0, len(points) - 1)], None
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        cx, cy = bx - ax, by - ay
        if b - a <= SHORT:
            if cx or cy:
                far = [abs(cx * (y - ay) - cy * (x - ax)) for x, y in points[a + 1 : b]]
            else:
                far = [(x - ax) ** 2 + (y - ay) ** 2 for x, y in points[a + 1 : b]]
            most = max(far)
            k = far.index(most)
        else:
            whole = np.array(points, dtype=np.int64) if whole is None else whole
            rest = whole[a + 1 : b] - whole[a]
            far = np.abs(cx * rest[:, 1] - cy * rest[:, 0]) if cx or cy else (rest**2).sum(axis=1)
            k = int(far.argmax())
            most = int(far[k])
        if (most / math.hypot(cx, cy) if cx or cy else math.sqrt(most)) > tolerance:
            keep[a + 1 + k] = 1
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [p for p, k in zip(points, keep, strict=True) if k]


def traced_labels(labels: np.ndarray, tolerance: float) -> list[tuple[int, int, int, float, str]]:
    """(label, loops, nodes, area, path text) of each label of 0 or more."""
    rows = []
    for label in np.unique(labels[labels >= 0]).tolist():
        d, nodes, double = [], 0, 0
        loops = outlines(labels == label)
        for loop in loops:
            closed = [*loop, loop[0]]
            double += sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(loop, closed[1:], strict=True))
            kept = _simplified_corners(closed, tolerance)[:-1]
            nodes += len(kept)
            d.append("M" + "L".join(f"{x} {y}" for x, y in kept) + "Z")
        rows.append((label, len(loops), nodes, double / 2, "".join(d)))
    return rows


#: Pixels up to which an image is one row, and pixels that are taken at once.
SMALL_IMAGE, PIXELS_AT_ONCE = 1024, 1 << 16

TRACED = {"img_id": pa.int64(), "label": pa.int32(), "loops": pa.int64(), "nodes": pa.int64(), "area": pa.float64(), "d": pa.string()}


def _traced_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(TRACED)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(TRACED.items(), columns, strict=True)})


def _traced_image(image: int, x: np.ndarray, y: np.ndarray, label: np.ndarray, tolerance: float) -> list[tuple]:
    labels = np.full((int(y.max()) + 1, int(x.max()) + 1), -1)
    labels[y, x] = label
    return [(image, *r) for r in traced_labels(labels, tolerance)]


def traced(px: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """(img_id, label, loops, nodes, area, d): each label's outlines as simplified path text. Small images
    are one row each and come many to a batch, larger ones are one group."""

    def of_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            px = batch.column("px")
            ends, flat = px.offsets.to_numpy() - px.offsets[0].as_py(), px.flatten()
            x, y, label = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "label"))
            rows, before = [], 0
            for image, s, e in zip(batch.column("img_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                rows += _traced_image(image, x[s:e], y[s:e], label[s:e], tolerance)
                if e - before >= PIXELS_AT_ONCE:
                    yield from _traced_table(rows).to_batches()
                    rows, before = [], e
            yield from _traced_table(rows).to_batches()

    def of_group(tab: pa.Table) -> pa.Table:
        x, y, label = (tab.column(c).to_numpy() for c in ("x", "y", "label"))
        return _traced_table(_traced_image(tab.column("img_id")[0].as_py(), x, y, label, tolerance))

    schema = "img_id long, label int, loops long, nodes long, area double, d string"
    px = px.select("img_id", "x", "y", "label")
    large = [r[0] for r in px.groupBy("img_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_IMAGE).select("img_id").limit(1).collect()]
    few = px
    if large:
        size = F.count("*").over(Window.partitionBy("img_id"))
        few, many = (px.withColumn("n", size).where(c).drop("n") for c in (F.col("n") <= SMALL_IMAGE, F.col("n") > SMALL_IMAGE))
    one = few.groupBy("img_id").agg(F.collect_list(F.struct("x", "y", "label")).alias("px"))
    out = one.mapInArrow(of_rows, schema)
    return out.unionByName(many.groupBy("img_id").applyInArrow(of_group, schema)) if large else out


def bezier(control: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Places of a curve, or of a stack of curves, at parameters."""
    s = 1 - t
    return np.stack([s**3, 3 * s * s * t, 3 * s * t * t, t**3], axis=-1) @ control


def fit_cubics(points: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """For a stack (chain, point, axis) of chains of one length: cubics with fixed ends by linear least
    squares over chord-length parameters, which are then moved towards the nearest places on the curve;
    and the largest distance that remains of each."""
    n = points.shape[1]
    steps = np.hypot(*np.moveaxis(np.diff(points, axis=1), 2, 0))
    t = np.concatenate([np.zeros((len(points), 1)), np.cumsum(steps, axis=1)], axis=1)
    whole = t[:, -1:]
    t = np.where(whole > 0, t / np.where(whole > 0, whole, 1), np.linspace(0, 1, n))
    best, error = np.zeros((len(points), 4, 2)), np.full(len(points), np.inf)
    first, last = points[:, :1], points[:, -1:]
    for _ in range(rounds):
        s = 1 - t
        basis = np.stack([3 * s * s * t, 3 * s * t * t], axis=2)
        rest = points - (s**3)[..., None] * first - (t**3)[..., None] * last
        inner = np.linalg.pinv(basis, rcond=np.finfo(float).eps * max(n, 2)) @ rest
        control = np.concatenate([first, inner, last], axis=1)
        gap = bezier(control, t) - points
        worst = np.hypot(gap[..., 0], gap[..., 1]).max(axis=1)
        better = worst < error
        best[better], error[better] = control[better], worst[better]
        speed = np.stack([s * s, 2 * s * t, t * t], axis=2) @ (3 * np.diff(control, axis=1))
        down = (speed**2).sum(axis=2)
        t = np.clip(t - np.where(down > 1e-12, (gap * speed).sum(axis=2) / np.maximum(down, 1e-12), 0), 0, 1)
    return best, error


def fit_cubic(points: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, float]:
    """``fit_cubics`` for one chain."""
    control, error = fit_cubics(np.asarray(points, float)[None], rounds)
    return control[0], float(error[0])


#: Points of chains that are fitted at once.
AT_ONCE = 65_536


def _fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        chains = batch.column("chain")
        size = chains.value_lengths().to_numpy(zero_copy_only=False)
        start = chains.offsets.to_numpy()[:-1]
        x, y = (chains.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        for n in np.unique(size[size >= 4]).tolist():
            same, step = np.nonzero(size == n)[0], max(1, AT_ONCE // n)
            for some in (same[k : k + step] for k in range(0, len(same), step)):
                at = start[some][:, None] + np.arange(n)
                control, error = fit_cubics(np.stack([x[at], y[at]], axis=2))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(some) + 1, 8), pa.int32()), pa.array(control.reshape(-1)))
                yield pa.RecordBatch.from_pydict({"g": batch.column("g").take(pa.array(some)), "n": pa.array(np.full(len(some), n)), "control": flat, "error": pa.array(error)})


def fitted_cubics(chains: DataFrame) -> DataFrame:
    """(g, n, control, error) for chains (g, i, x, y) of at least four points. A chain is one row and
    chains of one length in a batch are fitted together."""
    point = F.struct("i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = chains.groupBy(F.col("g").cast("long").alias("g")).agg(F.array_sort(F.collect_list(point)).alias("chain")).where(F.size("chain") >= 4)
    rows = rows.select("g", F.transform("chain", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("chain"))
    return rows.mapInArrow(_fitted, "g long, n long, control array<double>, error double")


def plane_fit(px: DataFrame) -> DataFrame:
    """Per region the slope of the level in x and y, from centred moments. Regions that are too
    small or too thin to have one are left out."""
    e = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
    m = px.where("label >= 0").groupBy("img_id", "label").agg(
        F.count("*").alias("n"), e("x", "x").alias("sxx"), e("y", "y").alias("syy"), e("x", "y").alias("sxy"), e("x", "v").alias("sxv"), e("y", "v").alias("syv")
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    m = m.withColumn("det", det).where("n >= 6 and det > 1e-6")
    gx = (F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy")) / F.col("det")
    gy = (F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy")) / F.col("det")
    return m.select("img_id", "label", "n", gx.alias("gx"), gy.alias("gy"))
