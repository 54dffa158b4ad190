"""Regions and floods in tiles against one pass over the whole image."""

from __future__ import annotations

import heapq
import random

import pytest

from lodestone.operators import tiles as T
from lodestone.sources.scratch import written

FLOOD = "img_id long, x int, y int, area long, cost long, seed long"


def keep(df):
    return written(df, "test-tiles")


def neighbours(x, y, eight):
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    return [(x + a, y + b) for a, b in steps]


def least_numbers(label, eight):
    out = {}
    for start in sorted(label, key=lambda p: (p[1], p[0])):
        if start in out:
            continue
        stack, out[start] = [start], start[1] * 65_536 + start[0]
        while stack:
            p = stack.pop()
            for q in neighbours(*p, eight):
                if q in label and q not in out and label[q] == label[p]:
                    out[q] = out[start]
                    stack.append(q)
    return out


@pytest.mark.parametrize("eight,levels,size", [(False, 2, 16), (True, 3, 20), (True, 2, 256), (False, 2, 1)])
def test_regions_equal_a_walk(spark, eight, levels, size):
    r = random.Random(levels)
    images = {i: {(x, y): r.choice([*range(levels), None]) for x in range(64) for y in range(64) if r.random() < 0.97} for i in ((3, 70_000) if size > 1 else (3,))}
    if size == 1:
        images = {3: {p: v for p, v in images[3].items() if p[0] < 12 and p[1] < 12}}
    rows = [(i, x, y, v, "kept") for i, m in images.items() for (x, y), v in m.items()]
    px = spark.createDataFrame(rows, "img_id long, x int, y int, label int, cluster string")
    found = {(i, x, y): c for i, x, y, _, note, c in map(tuple, T.regions(px, eight, keep, size).collect()) if note == "kept"}
    assert found == {(i, *p): c for i, m in images.items() for p, c in least_numbers(m, eight).items()}


def test_a_snake_through_many_tiles_is_one_region(spark):
    label = {(x, y): int(y % 2 == 0 or x == (39 if y % 4 == 1 else 0)) for x in range(40) for y in range(40)}
    px = spark.createDataFrame([(1, x, y, v) for (x, y), v in label.items()], "img_id long, x int, y int, label int")
    found = T.regions(px, False, keep, 8).where("label = 1").select("comp").distinct().collect()
    assert [r[0] for r in found] == [0]


def by_heap(px):
    """px: (x, y) -> (area, cost, seed)."""
    out, heap = {}, []

    def offer(p, level, hops, by):
        for q in neighbours(*p, False):
            if q in px and q not in out and px[q][2] < 0 and px[q][0] == px[p][0]:
                c = px[q][1]
                heapq.heappush(heap, (max(level, c), hops + 1 if c <= level else 0, by, q))

    for p, (_, _, seed) in px.items():
        if seed >= 0:
            out[p] = (0, 0, seed)
    for p in list(out):
        offer(p, 0, 0, out[p][2])
    while heap:
        level, hops, by, p = heapq.heappop(heap)
        if p not in out:
            out[p] = (level, hops, by)
            offer(p, level, hops, by)
    return out


def image(seed, n):
    r = random.Random(seed)
    return {
        (x, y): (int(x > n * 2 // 3) if seed % 2 else 0, r.randint(0, 9), r.randint(0, 5) if r.random() < 0.01 else -1)
        for x in range(n)
        for y in range(n)
        if r.random() < 0.95
    }


@pytest.mark.parametrize("seed,n,size", [(0, 64, 32), (1, 64, 24), (2, 40, 256), (3, 24, 7)])
def test_floods_equal_one_heap(spark, seed, n, size):
    images = {5: image(seed, n), 6: image(seed + 10, n // 2)}
    rows = [(i, *p, *v) for i, px in images.items() for p, v in px.items()]
    out = T.flooded(spark.createDataFrame(rows, FLOOD), keep, size, most_rounds=60).collect()
    found = {(r["img_id"], r["x"], r["y"]): (r["level"], r["hops"], r["label"]) for r in out}
    expected = {(i, *p): v for i, px in images.items() for p, v in by_heap(px).items()}
    assert {k: v for k, v in found.items() if v[2] >= 0} == expected and len(found) == len(rows)


def test_tiles_of_a_flood_grow_until_an_image_fits_into_one(spark):
    # a path to and fro over the border at x = 8, on which tiles of one size pass the claim on once a round
    free = {(x, y) for y in range(0, 32, 2) for x in range(16)} | {(15 if y % 4 == 1 else 0, y) for y in range(1, 31, 2)}
    rows = [(1, x, y, 0, 0, 3 if (x, y) == (0, 0) else -1) for x, y in sorted(free)]
    rounds = []
    hold = lambda df: rounds.append(1) or keep(df)
    out = T.flooded(spark.createDataFrame(rows, FLOOD), hold, 8).collect()
    assert {r["label"] for r in out} == {3} and max(r["hops"] for r in out) == len(free) - 1 and len(rounds) <= 3
    # where tiles may not hold the image, rounds go on to the same end
    assert sorted(T.flooded(spark.createDataFrame(rows, FLOOD), keep, 8, most=16).collect()) == sorted(out)


def test_a_flood_without_seeds_or_pixels(spark):
    rows = [(1, x, 0, 0, 5, -1) for x in range(3)]
    out = T.flooded(spark.createDataFrame(rows, FLOOD), keep).collect()
    assert [r["label"] for r in out] == [-1] * 3
    assert T.flooded(spark.createDataFrame([], FLOOD), keep).collect() == []


def test_growth_equals_a_scan_for_the_least(spark):
    r = random.Random(7)
    tone = [0, 10, 20, 30]
    label = {(x, y): r.randint(0, 3) for x in range(64) for y in range(64)}
    holes = {p for p in label if r.random() < 0.3}
    comp = least_numbers({p: 0 for p in holes}, False)
    v = {p: r.randint(0, 30) for p in holes}
    rows = [(1, comp[p], *p, float(v[p]), [(label[q], float(tone[label[q]])) for q in {q for q in neighbours(*p, False) if q in label and q not in holes}]) for p in holes]
    px = spark.createDataFrame(rows, "img_id long, comp long, x int, y int, v double, rim array<struct<label:int,tone:double>>")
    found = {(r["x"], r["y"]): r["label"] for r in T.grown(px).collect()}
    out = {}
    for c in {*comp.values()}:
        inside = {p for p in holes if comp[p] == c}
        while True:
            waiting = [((v[p] - tone[k]) ** 2, p[1], p[0], k) for p in inside if p not in out for q in neighbours(*p, False) if q in out or (q in label and q not in holes) for k in [out.get(q, label[q])]]
            if not waiting:
                break
            _, y, x, k = min(waiting)
            out[x, y] = k
    assert found == out


def test_marks_go_to_the_nearest_smooth_pixel(spark):
    r = random.Random(1)
    smooth = [(1, x, y) for x in range(40) for y in range(40) if r.random() < 0.02]
    marks = [(1, k, r.randrange(40), r.randrange(40)) for k in range(30)] + [(1, 90, *smooth[0][1:]), (2, 0, 5, 5)]
    found = {(r["img_id"], r["mark"]): (r["x"], r["y"]) for r in T.snapped(spark.createDataFrame(marks, "img_id long, mark int, mx int, my int"), spark.createDataFrame(smooth, "img_id long, x int, y int"), 6).collect()}
    there, expected = {(x, y) for _, x, y in smooth}, {}
    for i, k, mx, my in marks:
        for far in range(7):
            ring = [(mx + d, my + s * far) for d in range(-far, far + 1) for s in (-1, 1)] + [(mx + s * far, my + d) for d in range(1 - far, far) for s in (-1, 1)]
            hit = [p for p in ring if p in there]
            if i == 1 and hit:
                expected[i, k] = hit[0]
                break
    assert found == expected
