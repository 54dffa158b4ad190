"""Palettes of many histograms at once against loops over one."""

from __future__ import annotations

import random

from lodestone.operators import segment as E


def by_loop(levels, k, rounds):
    h = sorted((v, levels.count(v)) for v in set(levels))
    whole, run, centres = len(levels), 0, []
    shares = []
    for v, n in h:
        run += n
        shares.append(((run - n / 2) / whole, v))
    for i in range(k):
        centres.append(float(next((v for s, v in shares if s >= (i + 0.5) / k), h[-1][0])))
    centres = sorted(set(centres))
    for turn in range(rounds + 1):
        own = {}
        for v, n in h:
            own.setdefault(min(centres, key=lambda c: (abs(v - c), c)), []).append((v, n))
        if turn == rounds:
            break
        centres = sorted(sum(v * n for v, n in g) / sum(n for _, n in g) for g in own.values())
    rows = sorted((-sum(n for _, n in g), c) for c, g in own.items())
    return [(e, c, -n) for e, (n, c) in enumerate(rows)]


def test_palettes_of_many_images_equal_loops(spark):
    r = random.Random(11)
    images = {i: [r.randrange(1 + 8 * (i % 9)) for _ in range(1 + 7 * (i % 13))] for i in range(120)}
    rows = [(i, v) for i, px in images.items() for v in px]
    px = spark.createDataFrame(rows, "img_id long, v int")
    for k, rounds in ((4, 6), (1, 2), (5, 0)):
        found = {}
        for x in E.weighted_palette(px, k, rounds).collect():
            found.setdefault(x["img_id"], []).append((x["entry"], x["level"], x["count"]))
        assert {i: sorted(e) for i, e in found.items()} == {i: by_loop(levels, k, rounds) for i, levels in images.items()}


def test_rounds_of_a_palette_are_no_nested_expressions(spark):
    px = spark.createDataFrame([(1, 5), (1, 9), (2, 7)], "img_id long, v int")
    plan = E.weighted_palette(px, 4, 6)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan and "Window" not in plan
