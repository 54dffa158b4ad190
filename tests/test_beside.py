"""Values beside each other, boxes under later ones and chosen tops, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import spatial as D
from lodestone.operators import tree as T
from lodestone.sources.scratch import written


def test_values_beside_without_pairs(spark):
    r = random.Random(5)
    own = [(i, r.randrange(2), r.choice([None, round(r.uniform(-50, 50), 1)])) for i in range(60)] + [(99, 7, 1.0)]
    others = [(r.randrange(2), round(r.uniform(-50, 50), 1)) for _ in range(25)] + [(0, None)]
    got = {x["id"]: x for x in D.with_beside(spark.createDataFrame(own, "id long, g int, a double"), spark.createDataFrame(others, "g int, b double"), "g", "a", "b", 4.0).collect()}
    assert set(got) == {i for i, _, a in own if a is not None}
    for i, g, a in own:
        if a is None:
            continue
        near = [abs(a - b) for h, b in others if h == g and b is not None and abs(a - b) <= 4]
        found = [abs(a - b) for b in (got[i]["below"], got[i]["above"]) if b is not None and abs(a - b) <= 4]
        assert min(near, default=None) == min(found, default=None)


def test_gaps_need_no_join(spark):
    """A supplier is not joined with all customers near it, so a hundred times the rows is a hundred times the work."""
    from lodestone.plans.graphs import caption_gaps

    plan = caption_gaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_the_latest_box_over_a_point(spark):
    r = random.Random(6)
    boxes = [(r.randrange(2), i, float(r.randrange(-12, 30)), float(r.randrange(-12, 30)), r.choice([0.0, 3.0, 8.0, 17.0]), r.choice([0.0, 2.5, 9.0])) for i in range(300)]
    points = [(r.randrange(2), r.randrange(-20, 90) / 2, r.randrange(-20, 90) / 2) for _ in range(300)]
    found = D.latest_over(spark.createDataFrame(points, "g int, mx double, my double"), spark.createDataFrame(boxes, "g int, id long, x double, y double, w double, h double"), "g")
    got = {tuple(x)[:3]: x["latest"] for x in found.collect()}
    for g, x, y in points:
        over = [i for h, i, bx, by, w, d in boxes if h == g and bx <= x <= bx + w and by <= y <= by + d]
        assert got.get((g, x, y)) == max(over, default=None)


def test_tops_of_chosen_nodes(spark):
    rows = [("a", None, 1), ("b", "a", 0), ("c", "b", 1), ("d", None, 0), ("e", "d", 1), ("f", "e", 1), ("g", "e", None), ("h", "gone", 1), ("i", "h", 1)]
    keep = lambda df: written(df, "tops")
    nodes = spark.createDataFrame(rows, "id string, parent string, ord int")
    assert {x["id"] for x in T.top_level(nodes, F.col("ord") == 1, keep).collect()} == {"a", "e", "h"}
    with pytest.raises(ValueError):
        T.top_level(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "id string, parent string, ord int"), F.col("ord") == 1, keep)
