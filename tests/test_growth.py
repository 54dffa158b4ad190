"""Steps whose work follows their input: against loops on crowded input, and without broadcasts of tables that grow."""

from __future__ import annotations

from lodestone.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_snapped_boxes_on_a_crowded_sheet_equals_a_loop(spark, tmp_path):
    parts = [(k * 7919 % 1201, f"B{k % 2}", k * 31 % 50) for k in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["snapped_boxes"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(df)
    boxes = [(g, k, float(k * 53 % 400), 4.0 + s % 17) for k, g, s in parts]
    expected = {}
    for g, k, x, w in boxes:
        mine, moves = {("edge", x), ("center", x + w / 2), ("edge", x + w)}, []
        for h, j, y, v in boxes:
            if h == g and j < k:
                moves += [t - a for r, a in mine for q, t in {("edge", y), ("center", y + v / 2), ("edge", y + v)} if r == q and abs(t - a) <= 3]
        expected[g, k] = min(moves, key=lambda m: (abs(m), m)) if moves else None
    assert {(r["g"], r["id"]): r["move"] for r in df.collect()} == expected


def test_boxes_at_gap_equal_a_loop(spark):
    import random

    from lodestone.operators import spatial as D
    from lodestone.sources.scratch import written

    r = random.Random(5)
    boxes = [(k % 3, k, r.uniform(-60, 60), r.uniform(-60, 60), r.choice([0.0, r.uniform(0, 9), r.uniform(0, 25)]), r.uniform(0, 7)) for k in range(240)]
    boxes += [(0, 1000 + k, 100.0, 10.0 * k, 4.0, 4.0) for k in range(4)] + [(0, 1010, 110.0, -3.0, 1.0, 1.0), (0, 1011, 90.0, 43.0, 4.0, 1.0)]
    at = {b[1]: b for b in boxes}
    root = {k: k for k in at}

    def top(k):
        return k if root[k] == k else top(root[k])

    for i, (g, _, x, y, w, h) in at.items():
        for j, (f, _, u, v, p, q) in at.items():
            if g == f and i < j and max(x, u) - min(x + w, u + p) <= 6 and max(y, v) - min(y + h, v + q) <= 6:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = D.boxes_at_gap(spark.createDataFrame(boxes, "g long, id long, x double, y double, w double, h double"), "g", 6.0, lambda df: written(df, "test-boxes"))
    assert {x["id"]: x["cluster"] for x in found.collect()} == {k: top(k) for k in at}


def test_crossings_in_blocks_equal_a_loop(spark):
    import random

    from lodestone.operators import spatial as D

    r = random.Random(6)
    segments = [(k, *(r.uniform(-1, 1) for _ in range(4))) for k in range(70)] + [(100 + k, x, 0.05, x + 0.04, -0.05) for k, x in enumerate([0.01 * n for n in range(20)])]

    def side(a, x, y):
        v = (a[3] - a[1]) * (y - a[2]) - (a[4] - a[2]) * (x - a[1])
        return (v > 0) - (v < 0)

    cross = lambda a, b: side(a, *b[1:3]) * side(a, *b[3:]) < 0 and side(b, *a[1:3]) * side(b, *a[3:]) < 0
    expected = {(a[0], b[0]) for a in segments for b in segments if a[0] < b[0] and cross(a, b)}
    found = D.crossings(spark.createDataFrame(segments, "id long, x0 double, y0 double, x1 double, y1 double"), 0.3, block=5)
    rows = [tuple(x) for x in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    # pairs that are found are not shuffled: the join is the last step that needs one
    assert plan(found).split("SortMergeJoin")[0].count("HashAggregate") == 0


def test_segments_of_crossings_are_not_multiplied(spark):
    """Long and short, endless, repeated and incomplete segments meet as in a loop, and go out by the block."""
    import math
    import random

    from lodestone.operators import spatial as D

    r = random.Random(8)
    near = lambda v: v + r.uniform(-0.01, 0.01)
    segments = [(k, *(r.uniform(-50, 50) for _ in range(4))) for k in range(60)]
    segments += [(100 + k, x, y, near(x), near(y)) for k, (x, y) in enumerate((r.uniform(0, 0.1), r.uniform(0, 0.1)) for _ in range(120))]
    segments += [(300, -1.0, 0.05, math.inf, 0.06), (301, 0.0, -math.inf, 0.01, math.inf), (302, 0.0, math.nan, 1.0, 1.0), (303, None, 0.0, 1.0, 1.0), (None, -9.0, -9.0, 9.0, 9.0)]
    segments += [segments[5], (5, *segments[9][1:]), (101, *segments[0][1:])]

    def side(a, x, y):
        v = (a[3] - a[1]) * (y - a[2]) - (a[4] - a[2]) * (x - a[1])
        return (v > 0) - (v < 0)

    cross = lambda a, b: side(a, *b[1:3]) * side(a, *b[3:]) < 0 and side(b, *a[1:3]) * side(b, *a[3:]) < 0
    whole = [s for s in segments if None not in s]
    expected = sorted((a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and cross(a, b))
    df = spark.createDataFrame(segments, "id long, x0 double, y0 double, x1 double, y1 double")
    assert expected and any(b == 300 for _, b in expected)
    for block in (4, 1000):
        found = D.crossings(df, 0.1, block=block)
        assert "Generate" not in plan(found) and "explode" not in plan(found)
        assert sorted(tuple(x) for x in found.collect()) == expected


def test_no_table_of_inlined_styles_or_despeckled_pixels_is_broadcast(spark):
    for name in ("inlined_styles", "despeckle_components"):
        found = plan(QUERIES[name](spark, SF))
        assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found
