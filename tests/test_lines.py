"""Coverage and joined ends against plain loops."""

from __future__ import annotations

import math
import random

from lodestone.operators import lines as L
from lodestone.sources.scratch import written


def keep(df):
    return written(df, "test-lines")


def test_matching_takes_the_nearest_first(spark):
    r = random.Random(1)
    pairs = [(a, b, float(r.randint(0, 6))) for a in range(30) for b in range(a + 1, 30) if r.random() < 0.3]
    used, expected = set(), set()
    for gap, a, b in sorted((g, a, b) for a, b, g in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            expected.add((a, b))
    found = L.matched_ends(spark.createDataFrame(pairs, "lo long, hi long, gap double"), keep).collect()
    assert {(x["lo"], x["hi"]) for x in found} == expected and len(found) == len(expected)


def joined_by_loop(curves, reach):
    """curves: number -> points. Paths as sets of nodes in order from either end."""
    ends = {2 * c + k: p[-k] if k else p[0] for c, p in curves.items() if len(p) > 1 for k in (0, 1)}
    pairs = sorted((round(math.dist(ends[a], ends[b]), 9), a, b) for a in ends for b in ends if a < b and math.dist(ends[a], ends[b]) <= reach)
    mate = {}
    for _, a, b in pairs:
        if a not in mate and b not in mate:
            mate[a], mate[b] = b, a
    out, seen = {}, set()
    for ring in (False, True):
        for start in sorted(ends):
            if start // 2 in seen or (start in mate) != ring:
                continue
            nodes, end, members = [], start, []
            while True:
                c = end // 2
                seen.add(c)
                members.append(c)
                pts = [tuple(map(float, p)) for p in (curves[c] if end % 2 == 0 else curves[c][::-1])]
                if end in mate:
                    pts[0] = tuple((a + b) / 2 for a, b in zip(pts[0], ends[mate[end]], strict=True))
                out_end = end ^ 1
                nodes += pts[:-1] if out_end in mate else pts
                if out_end not in mate or mate[out_end] == start:
                    break
                end = mate[out_end]
            out[min(members)] = (nodes, ring)
    return out


def same(a, b, ring):
    turns = [b[k:] + b[:k] for k in range(len(b))] if ring else [b]
    return any(all(math.dist(p, q) < 1e-9 for p, q in zip(a, t, strict=True)) for w in turns for t in (w, w[::-1]))


def test_joined_ends_equal_a_walk(spark):
    r = random.Random(2)
    rows, expected = [], {}
    for sheet in range(4):
        curves = {sheet * 100 + c: [(r.uniform(0, 12), r.uniform(0, 12)) for _ in range(r.randint(1, 4))] for c in range(25)}
        rows += [(sheet, c, i, x, y) for c, pts in curves.items() for i, (x, y) in enumerate(pts)]
        expected |= {(sheet, k): v for k, v in joined_by_loop(curves, 1.5).items()}
    # a square of four sides, and one curve whose ends meet
    square = {900: [(50, 50), (60, 50)], 901: [(60, 50.2), (60, 60)], 902: [(50, 60), (60, 60.2)], 903: [(50, 60), (50.2, 50)], 910: [(80, 80), (85, 80), (80, 80.5)]}
    rows += [(9, c, i, float(x), float(y)) for c, pts in square.items() for i, (x, y) in enumerate(pts)]
    expected |= {(9, k): v for k, v in joined_by_loop(square, 1.5).items()}
    got: dict[tuple, list] = {}
    for x in L.joined_ends(spark.createDataFrame(rows, "sheet int, curve long, i int, x double, y double"), ["sheet"], 1.5, keep).collect():
        got.setdefault((x["sheet"], x["path"]), []).append((tuple(x["ord"]), x["x"], x["y"], x["closed"]))
    assert got.keys() == expected.keys() and any(v[1] for v in expected.values())
    for k, pts in got.items():
        nodes, ring = expected[k]
        assert len(pts) == len(nodes) and pts[0][3] == ring, k
        assert same([p[1:3] for p in sorted(pts)], nodes, ring), k


def test_coverage_equals_a_loop(spark):
    r = random.Random(5)
    a = [(1, c, i, r.uniform(0, 6), r.uniform(0, 6)) for c in range(3) for i in range(4)] + [(2, 7, i, float(i), 0.0) for i in range(3)]
    b = [(1, 5, i, r.uniform(0, 6), r.uniform(0, 6)) for i in range(9)]
    frame = lambda rows: spark.createDataFrame(rows, "g int, curve int, i int, x double, y double")

    def samples(rows):
        out = {}
        for g, c in {(x[0], x[1]) for x in rows}:
            pts, k, done = [x[3:] for x in rows if x[:2] == (g, c)], 0, 0.0
            for p, q in zip(pts, pts[1:], strict=False):
                n = math.dist(p, q)
                while k * 0.25 < done + n - 1e-9:
                    t = (k * 0.25 - done) / n
                    out[g, c, k] = tuple(u + t * (v - u) for u, v in zip(p, q, strict=True))
                    k += 1
                done += n
        return out

    sa, sb = samples(a), samples(b)
    far = {k: min((math.dist(p, q) for m, q in sb.items() if m[0] == k[0]), default=None) for k, p in sa.items()}
    d = keep(L.distances(frame(a), frame(b), ["g"], 0.25, keep))
    found = {(x["g"], x["curve"], x["k"]): x["distance"] for x in d.collect()}
    assert found.keys() == far.keys()
    assert all((found[k] is None) == (far[k] is None) and (far[k] is None or abs(found[k] - far[k]) < 1e-6) for k in far)
    for x in L.covered(d, ["g"], 0.25, 0.5).collect():
        near = [far[k] is not None and far[k] <= 0.5 for k in sorted(far) if k[:2] == (x["g"], x["curve"])]
        runs = sum(v and not (i and near[i - 1]) for i, v in enumerate(near))
        assert (x["length"], x["covered"], x["stretches"]) == ((len(near) - 1) * 0.25, (sum(near) - runs) * 0.25, runs)


def test_distances_both_ways_of_small_and_large_groups_equal_a_loop(spark, monkeypatch):
    import math
    import random

    from lodestone.sources.scratch import written

    r = random.Random(8)
    line = lambda g, c, n: [(g, c, i, float(i), r.uniform(0, 2)) for i in range(n)]
    curves = line(0, 0, 5) + line(0, 1, 4) + line(1, 0, 40) + line(2, 0, 3)
    others = line(0, 0, 6) + line(1, 0, 30) + line(3, 4, 3)
    frame = lambda rows: spark.createDataFrame(rows, "g int, curve int, i int, x double, y double")
    keep = lambda df: written(df, "test-distances")
    at = lambda rows: {(x["g"], x["curve"], x["k"]): (x["x"], x["y"]) for x in L._samples(frame(rows), ["g"], 0.5).collect()}
    a, b = at(curves), at(others)
    expected = {}
    for other, own, to in ((False, a, b), (True, b, a)):
        for key, p in own.items():
            expected[other, *key] = min((math.dist(p, q) for k, q in to.items() if k[0] == key[0]), default=None)
    # all groups as rows, then the one with some 90 samples through cells
    for small in (1024, 60):
        monkeypatch.setattr(L, "SMALL", small)
        rows = L.mutual_distances(frame(curves), frame(others), ["g"], 0.5, keep).collect()
        found = {(x["other"], x["g"], x["curve"], x["k"]): x["distance"] for x in rows}
        assert len(rows) == len(found) == len(expected)
        for k, d in expected.items():
            assert (d is None) == (found[k] is None) and (d is None or abs(found[k] - d) < 1e-5)


def test_samples_of_curves_dealt_by_group_are_not_shuffled(spark):
    from lodestone.plans import lines as P
    from lodestone.sources.scratch import written

    drawn, traced = P._curves(spark, "/root/testdata/sf0.001")
    plan = L.mutual_distances(drawn, traced, ["g"], 0.5, lambda df: written(df, "test-distances"))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)
