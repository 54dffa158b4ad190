"""Outlined strokes against areas known and distances to the line."""

from __future__ import annotations

import math
import random

import pytest

from lodestone.operators import scan as R
from lodestone.operators.stroke import outlined


def ink(spark, lines, join, cap, size=64, lines_a_row=16):
    rows = [(g, i, float(x), float(y), float(w)) for g, (w, pts) in lines.items() for i, (x, y) in enumerate(pts)]
    o = outlined(spark.createDataFrame(rows, "g int, i int, x double, y double, w double"), ["g"], "w", join, cap, pieces=16)
    c = R.coverage(R.closed_edges(o, ["g"]), ["g"], size, size, rows=lines_a_row).collect()
    out: dict[int, dict] = {g: {} for g in lines}
    for r in c:
        out[r["g"]][r["x"], r["y"]] = r["coverage"]
    return out


@pytest.mark.parametrize("join,cap,straight", [("bevel", "butt", 80), ("miter", "butt", 80), ("bevel", "square", 96), ("round", "round", 80 + 4 * math.pi)])
def test_areas(spark, join, cap, straight):
    lines = {0: (4, [(10, 10), (30, 10)]), 1: (4, [(10, 10), (10, 10), (30, 10), (30, 30), (30, 30)]), 2: (4, [(5, 5), (5, 5)]), 3: (4, [(10, 10), (20, 10), (30, 10)])}
    found = {g: sum(c.values()) for g, c in ink(spark, lines, join, cap).items()}
    assert found[2] == 0 and found[0] == pytest.approx(straight, abs=0.3) and found[3] == pytest.approx(straight, abs=0.3)
    # two arms of 20 by 4 that share a quarter square; the join fills what is outside it
    outer = {"bevel": 2, "miter": 4, "round": math.pi}[join]
    ends = {"butt": 0, "square": 16, "round": 4 * math.pi}[cap]
    assert found[1] == pytest.approx(160 - 4 + outer + ends, abs=0.4)


def test_round_strokes_hold_what_lies_near_the_line(spark):
    r = random.Random(0)
    lines = {g: (r.uniform(2, 9), [(r.uniform(8, 56), r.uniform(8, 56)) for _ in range(5)]) for g in range(6)}

    def far(p, pts):
        best = math.inf
        for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
            t = ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
            t = min(1, max(0, t))
            best = min(best, math.hypot(ax + t * (bx - ax) - p[0], ay + t * (by - ay) - p[1]))
        return best

    for g, cover in ink(spark, lines, "round", "round").items():
        w, pts = lines[g]
        for x in range(64):
            for y in range(64):
                d = far((x + 0.5, y + 0.5), pts) - w / 2
                if abs(d) > 0.8:
                    assert cover.get((x, y), 0) == pytest.approx(1 if d < 0 else 0, abs=0.02), (g, x, y, d)


def test_sharp_miters_become_bevels(spark):
    sharp = {0: (4, [(5, 30), (60, 30), (5, 31)])}
    a, b = (sum(ink(spark, sharp, j, "butt")[0].values()) for j in ("miter", "bevel"))
    assert a == pytest.approx(b)
