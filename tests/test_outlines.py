"""Chains, filled outlines and layers against walks and plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chains as H
from lodestone.operators import raster as K
from lodestone.operators import scan as R
from lodestone.sources.scratch import written


def keep(df):
    return written(df, "test-outlines")


def test_lists_and_rings_are_ranked(spark):
    r = random.Random(0)
    ids = r.sample(range(10**6), 400)
    lists = [ids[:1], ids[1:3], ids[3:140], ids[140:147], ids[147:400]]
    rows, expected = [], {}
    for k, items in enumerate(lists):
        ring = k in (1, 3, 4)
        if ring:
            at = items.index(min(items))
            items = items[at:] + items[:at]
        for i, x in enumerate(items):
            rows.append((x, items[i + 1] if i + 1 < len(items) else items[0] if ring else None))
            expected[x] = (items[-1], len(items) - 1 - i, ring)
    found = {i: tuple(rest) for i, *rest in map(tuple, H.ranked(spark.createDataFrame(rows, "id long, next long"), keep).collect())}
    assert found == expected
    one = spark.createDataFrame([(7, 7)], "id long, next long")
    assert [tuple(x) for x in H.ranked(one, keep).collect()] == [(7, 7, 0, True)]


def walked(label, n):
    """Chains as (corners, left, right, closed) by following steps from corner to corner."""
    at = lambda x, y: label.get((x, y), -1)
    sides = [lambda x, y: (at(x, y - 1), at(x, y)), lambda x, y: (at(x, y), at(x - 1, y)), lambda x, y: (at(x - 1, y), at(x - 1, y - 1)), lambda x, y: (at(x - 1, y - 1), at(x, y - 1))]
    ways = {(x, y): [d for d in range(4) if sides[d](x, y)[0] != sides[d](x, y)[1]] for x in range(n + 1) for y in range(n + 1)}
    out, used = [], set()

    def walk(x, y, d, closed):
        start, path, (left, right) = (x, y), [(x, y)], sides[d](x, y)
        while True:
            nx, ny = x + H.DX[d], y + H.DY[d]
            used.update([(x, y, d), (nx, ny, (d + 2) % 4)])
            x, y = nx, ny
            if closed and (x, y) == start:
                break
            path.append((x, y))
            if len(ways[x, y]) != 2:
                break
            d = next(k for k in ways[x, y] if k != (d + 2) % 4)
        out.append((tuple(path), left, right, closed))

    corners = sorted(ways, key=lambda p: (p[1], p[0]))
    for ring in (False, True):
        for x, y in corners:
            for d in ways[x, y]:
                if (x, y, d) not in used and (ring or len(ways[x, y]) > 2):
                    walk(x, y, d, ring)
    return sorted(out)


@pytest.mark.parametrize("seed,levels,block", [(0, 3, 1), (1, 2, 8)])
def test_chains_equal_a_walk(spark, seed, levels, block):
    r = random.Random(seed)
    n = 64
    coarse = {(x, y): r.randint(-1, levels - 1) for x in range(n // block) for y in range(n // block)}
    images = {i: {(x, y): coarse[(x // block + i) % (n // block), y // block] for x in range(n) for y in range(n)} for i in (1, 900)}
    px = spark.createDataFrame([(i, x, y, v) for i, m in images.items() for (x, y), v in m.items()], "img_id long, x int, y int, label int")
    got: dict[tuple, list] = {}
    for row in H.boundary_chains(K.cracks(px), keep).collect():
        got.setdefault((row["img_id"], row["chain"]), []).append((row["ord"], row["x"], row["y"], row["left"], row["right"], row["closed"]))
    for i, m in images.items():
        found = []
        for (img, _), rows in got.items():
            if img == i:
                rows.sort()
                assert [x[0] for x in rows] == list(range(len(rows)))
                found.append((tuple(x[1:3] for x in rows), *rows[0][3:]))
        assert sorted(found) == walked(m, n)


def covered_by_loop(poly, size, even_odd, lines=4):
    out = {}
    for k in range(size * lines):
        level, hits = (k + 0.5) / lines, []
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
            if (y0 <= level) != (y1 <= level):
                hits.append((x0 + (x1 - x0) * (level - y0) / (y1 - y0), 1 if y1 > y0 else -1))
        hits.sort()
        wind = 0
        for j in range(len(hits) - 1):
            wind += hits[j][1]
            if (j % 2 == 0) if even_odd else wind:
                for p in range(size):
                    part = min(hits[j + 1][0], p + 1) - max(hits[j][0], p)
                    if part > 0:
                        out[p, k // lines] = out.get((p, k // lines), 0) + part / lines
    return out


@pytest.mark.parametrize("even_odd", [False, True])
def test_coverage_equals_a_loop(spark, even_odd):
    r = random.Random(3)
    polys = {
        0: [(r.uniform(-10, 74), r.uniform(-10, 74)) for _ in range(40)],
        1: [(1, 1), (5, 1), (5, 5), (1, 5)],
        2: [(2.5, 0.125), (3, 0.125), (2.75, 9)],
        3: [(1, 1), (9, 1), (9, 1)],
        4: [(100, 100), (120, 100), (110, 130)],
    }
    rows = [(g, i, float(x), float(y)) for g, p in polys.items() for i, (x, y) in enumerate(p)]
    edges = R.closed_edges(spark.createDataFrame(rows, "g long, i int, x double, y double"), ["g"])
    found = {(x["g"], x["x"], x["y"]): x["coverage"] for x in R.coverage(edges, ["g"], 64, 64, even_odd).collect()}
    expected = {(g, *p): c for g, poly in polys.items() for p, c in covered_by_loop(poly, 64, even_odd).items()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], expected[k], abs_tol=1e-9) for k in found)
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, x, y): 1.0 for x in range(1, 5) for y in range(1, 5)}


def test_layers_lie_over_each_other(spark):
    rows = [(1, 0, 0, 2, 0.5, 100.0), (1, 0, 0, 1, 1.25, 0.0), (1, 3, 0, 5, 0.25, 55.0)]
    found = {(r["x"], r["y"]): r["level"] for r in R.composited(spark.createDataFrame(rows, "g long, x int, y int, z int, coverage double, tone double"), ["g"], "z", "tone").collect()}
    assert found == {(0, 0): 50.0, (3, 0): 205.0}


def test_lists_that_leave_a_block_are_ranked_too(spark):
    """Lists and rings in one block and over several; those in one block take a single table."""
    items = [(0, 1), (1, 2), (2, None), (4, 6), (6, 5), (5, 4), (8, 12), (12, 13), (13, 17), (17, None), (20, 24), (24, 28), (28, 20), (40, None), (15, 41), (41, None)]
    seen = []

    def keep(df):
        seen.append(df)
        return df.localCheckpoint()

    def found(rows, size):
        links = spark.createDataFrame(rows, "id long, next long").withColumn("block", F.floor(F.col("id") / size))
        got = H.ranked_in_blocks(links, ["block"], keep).collect()
        return {r["id"]: (r["first"], r["last"], r["rest"], r["steps"], r["closed"]) for r in got}

    whole = found(items, 1000)
    assert len(seen) == 1
    assert found(items, 4) == whole == found(items, 1)
    plain = {r["id"]: (r["last"], r["rest"], r["closed"]) for r in H.ranked(spark.createDataFrame(items, "id long, next long"), keep).collect()}
    assert {k: (v[1], v[2], v[4]) for k, v in whole.items()} == plain
    assert whole[6] == (4, 5, 1, 2, True) and whole[12] == (8, 17, 2, 3, False)


def test_networks_shuffle_vectors_not_pixels(spark):
    """One shuffle of vectors and one of the chains' corners; windows and tiles of an image need none."""
    from lodestone.plans.outlines import network_summary

    plan = network_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    from lodestone.operators import raster as K
    from lodestone.sources.roles import labels

    plan = K.cracks(labels(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_small_images_are_traced_in_batches_and_large_ones_alone(spark, monkeypatch):
    import random

    from lodestone.operators import geometry as G

    r = random.Random(12)
    images = {k: {(x, y): r.randrange(-1, 3) for x in range(n) for y in range(n)} for k, n in enumerate([3, 8, 8, 12, 1, 5])}
    px = spark.createDataFrame([(k, x, y, v) for k, image in images.items() for (x, y), v in image.items()], "img_id long, x int, y int, label int")
    found = []
    for small, at_once in ((1024, 1 << 16), (64, 70), (0, 1)):
        monkeypatch.setattr(G, "SMALL_IMAGE", small)
        monkeypatch.setattr(G, "PIXELS_AT_ONCE", at_once)
        df = G.traced(px, 0.0)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("FlatMapGroupsInArrow" in plan) == (small < 144)
        found.append(sorted(tuple(x) for x in df.collect()))
    assert found[0] == found[1] == found[2]
    counts = {(k, v): list(image.values()).count(v) for k, image in images.items() for v in range(3) if v in image.values()}
    assert {x[:2]: x[4] for x in found[0]} == counts
