"""Path grammar, arcs, inherited state and broken markup."""

from __future__ import annotations

import math
import random

import pytest

from lodestone.sources import drawings as D


def ends(d):
    return [(r, k, tuple(round(c, 6) for c in p[3])) for r, k, p in D.path_segments(d)]


@pytest.mark.parametrize(
    "d,expected",
    [
        ("M1 2L3,4", [(0, "L", (3, 4))]),
        ("m1 2 3 4-1-1", [(0, "L", (4, 6)), (0, "L", (3, 5))]),
        ("M0 0H5V5h-2v-.5.5", [(0, "L", (5, 0)), (0, "L", (5, 5)), (0, "L", (3, 5)), (0, "L", (3, 4.5)), (0, "L", (3, 5))]),
        ("M1 1l2 0z l0 3", [(0, "L", (3, 1)), (0, "Z", (1, 1)), (1, "L", (1, 4))]),
        ("M1 1l2 0zm1 1l1 0", [(0, "L", (3, 1)), (0, "Z", (1, 1)), (1, "L", (3, 2))]),
        ("M0 0c1 1 2 1 3 0s2-1 3 0", [(0, "C", (3, 0)), (0, "S", (6, 0))]),
        ("M0 0A5 5 0 0110 0", [(0, "A", (5, -5)), (0, "A", (10, 0))]),
        ("M0 0a5 5 0 0010 0", [(0, "A", (5, 5)), (0, "A", (10, 0))]),
        ("M0 0A0 5 0 0 1 10 0", [(0, "A", (10, 0))]),
        ("M0 0A5 5 0 0 1 0 0", []),
        ("M0 0L1 1L2", [(0, "L", (1, 1))]),
        ("M1e1-2E0L.5.5", [(0, "L", (0.5, 0.5))]),
        ("L1 1", []), ("", []), (None, []), ("M0 0 x", []), ("M0 0z1 1", [(0, "Z", (0, 0))]),
    ],
)
def test_path_data(d, expected):
    assert ends(d) == expected


def test_smooth_commands_mirror_the_control_before():
    _, second = [p for _, _, p in D.path_segments("M0 0C0 1 2 2 3 0S5 1 6 0")]
    assert second[1] == (4, -2)
    after_line = [p for _, _, p in D.path_segments("M0 0L3 0S5 1 6 0")][1]
    assert after_line[1] == (3, 0)
    q = [p for _, _, p in D.path_segments("M0 0Q1 3 2 0T4 0")]
    assert q[0][1] == pytest.approx((2 / 3, 2)) and q[1][1] == pytest.approx((2 + 2 / 3, -2))


def test_arcs_lie_on_their_ellipse():
    r = random.Random(0)
    for _ in range(300):
        p, q = ((r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(2))
        rx, ry, turn, large, sweep = r.uniform(1, 12), r.uniform(1, 12), r.uniform(-180, 180), r.random() < 0.5, r.random() < 0.5
        pieces = D.quarters(p, q, rx, ry, turn, large, sweep)
        assert pieces[0][0] == p and pieces[-1][3] == q
        cos, sin = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        flat = [((cos * x + sin * y) / rx, (cos * y - sin * x) / ry) for c in pieces for t in (0, 0.25, 0.5, 0.75, 1) for x, y in [tuple(sum(w * c[k][a] for k, w in enumerate(((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3))) for a in (0, 1))]]
        # all at one distance from one centre, which is the radius unless it had to grow
        (ax, ay), (bx, by), (cx, cy) = flat[0], flat[len(flat) // 2], flat[-1]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-3:
            continue
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        radius = math.hypot(ax - ux, ay - uy)
        assert all(abs(math.hypot(x - ux, y - uy) - radius) < 2e-3 * radius for x, y in flat)
        assert radius >= 1 - 1e-3 and (radius < 1 + 2e-3 or abs(math.hypot(cx - ax, cy - ay) - 2 * radius) < 1e-2)
        angles = [math.atan2(y - uy, x - ux) for x, y in flat]
        moved = sum((b - a + math.pi) % (2 * math.pi) - math.pi for a, b in zip(angles, angles[1:], strict=False))
        assert (moved > 0) == sweep and (radius > 1 + 1e-6 or (abs(moved) > math.pi - 1e-3) == large)


def test_state_is_inherited():
    got = D.items(
        '<?xml version="1.0"?><svg:svg xmlns:svg="http://www.w3.org/2000/svg" fill="red"><svg:g opacity=".5" transform="scale(2)" style="stroke:blue;stroke-width:3 !important">'
        '<svg:rect id="a" width="4" height="2" fill="inherit"/><svg:g visibility="hidden"><svg:path d="M0 0h1"/><svg:path visibility="visible" d="M1 1h1" opacity="0.5" fill-opacity=".5"/></svg:g>'
        '</svg:g><svg:symbol><svg:path d="M0 0h1"/></svg:symbol><svg:ellipse cx="1" rx="2" ry="1"/><svg:circle r="0"/><svg:polygon points="1,1 2,2,3 3 4"/></svg:svg>'
    )
    assert [(i["tag"], i["fill"], i["stroke"], i["width"], i["fill_opacity"], i["stroke_opacity"]) for i in got] == [("rect", "red", "blue", 6, 0.5, 0.5), ("path", "red", "blue", 6, 0.125, 0.25), ("ellipse", "red", "none", 1, 1, 1), ("polygon", "red", "none", 1, 1, 1)]
    assert got[0]["id"] == "a" and [s["p"][6:] for s in got[0]["segments"]] == [[8, 0], [8, 4], [0, 4], [0, 0]]
    assert [s["kind"] for s in got[3]["segments"]] == ["L", "L", "Z"]


def test_rounded_rectangles_and_broken_markup():
    (one,) = D.items('<svg><rect x="1" y="1" width="10" height="6" rx="9"/></svg>')
    assert [s["kind"] for s in one["segments"]] == ["L", "A", "L", "A", "L", "A", "L", "A", "Z"] and one["segments"][1]["p"][6:] == [11, 4]
    assert [i["tag"] for i in D.items("<svg><line x2='1'/><g></svg>")] == ["line", "broken"]
    assert [i["tag"] for i in D.items("<!DOCTYPE a [<!ENTITY b 'c'>]><svg><line x2='1'/></svg>")] == ["broken"]
    assert D.items(None) == D.items("") == D.items("  ") == []


def test_rows_of_segments(spark):
    docs = spark.createDataFrame([(1, "<svg><path d='M0 0h1v1z'/></svg>", 5), (2, None, 6)], "k int, svg string, item int").drop("item")
    rows = D.segment_rows(D.drawn_items(docs, "k", "svg"), "k").orderBy("seg").collect()
    assert [(r["k"], r["item"], r["ring"], r["kind"], r["x3"], r["y3"]) for r in rows] == [(1, 0, 0, "L", 1.0, 0.0), (1, 0, 0, "L", 1.0, 1.0), (1, 0, 0, "Z", 0.0, 0.0)]


def test_traced_outlines_render_to_their_pixels(spark):
    from lodestone.operators import geometry as G
    from lodestone.plans.drawings import _rendered

    r = random.Random(3)
    rows = [(i, x, y, r.randint(0, 2)) for i in (1, 2) for x in range(64) for y in range(64)]
    px = spark.createDataFrame(rows, "img_id long, x int, y int, label int")
    out = _rendered(G.traced(px, tolerance=0.0), px, 64).collect()
    assert len(out) == 6 and all(x["overlap"] == 1.0 and x["area"] == x["shared"] == sum(v[0] == x["img_id"] and v[3] == x["label"] for v in rows) for x in out)


def test_curves_flatten_to_their_points(spark):
    from lodestone.operators import scan as R

    docs = spark.createDataFrame([(1, "<svg><circle cx='20' cy='20' r='15'/><path d='M40 2L60 2L60 20'/></svg>")], "k int, svg string")
    edges = R.flattened(D.segment_rows(D.drawn_items(docs, "k", "svg"), "k"), ["k", "item"], 32)
    area = {r["item"]: r["a"] for r in R.coverage(edges, ["k", "item"], 64, 64).groupBy("item").agg({"coverage": "sum"}).toDF("item", "a").collect()}
    assert abs(area[0] - math.pi * 225) < 1.5 and abs(area[1] - 180) < 1e-6
