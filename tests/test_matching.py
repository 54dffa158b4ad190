"""Matching on a line, stretch by stretch, against taking one pair at a time."""

from __future__ import annotations

import math
import random

import numpy as np

from lodestone.operators import matching as M
from lodestone.sources.scratch import written


def greedy(left, right, gap):
    pairs = sorted((M._rounded(abs(a - b), 2), i, o) for i, g, a in left for o, h, b in right if None not in (g, h, a, b) and g == h and abs(a - b) <= gap)
    ids, oids, out = set(), set(), set()
    for d, i, o in pairs:
        if i not in ids and o not in oids:
            ids.add(i)
            oids.add(o)
            out.add((i, o, d))
    return out


def some(r, n, groups, span, grid):
    return [(k * 7 % 1009, k % groups, r.randrange(int(span / grid)) * grid) for k in range(n)]


def matched(spark, left, right, gap, together):
    a = spark.createDataFrame(left, "id long, g int, a double")
    b = spark.createDataFrame(right, "oid long, g int, b double")
    rows = M.matched_on_line(a, b, "g", "a", "b", gap, lambda df: written(df, "test-line"), together=together).collect()
    found = {(x["id"], x["oid"], x["gap"]) for x in rows}
    assert len(found) == len(rows)
    return found


def test_stretches_equal_one_pair_at_a_time(spark):
    r = random.Random(2)
    for n, m, span, grid, gap in ((120, 500, 300, 0.01, 9), (300, 300, 200, 1.0, 4), (300, 120, 400, 0.25, 3), (150, 150, 60, 0.001, 2)):
        left, right = some(r, n, 2, span, grid), some(r, m, 2, span, grid)
        left += [(2000, None, 1.0), (2001, 0, None), (2002, 0, math.nan), (2003, 0, math.inf)]
        assert matched(spark, left, right, gap, 20) == greedy([x for x in left if x[0] < 2000], right, gap)


def test_what_a_stretch_settles_holds_for_every_line_around_it():
    r = random.Random(3)
    settled = 0
    for _ in range(300):
        grid, gap = r.choice([(0.01, 5), (1.0, 4), (0.5, 30)]), 0
        grid, gap = grid
        left = [(k, 0, r.randrange(int(60 / grid)) * grid) for k in range(r.randrange(1, 40))]
        right = [(k, 0, r.randrange(int(60 / grid)) * grid) for k in range(r.randrange(1, 40))]
        low, high = 15.25, 44.75
        inside = lambda rows: [np.array([x[c] for x in rows if low < x[2] < high], dtype=t) for c, t in ((0, np.int64), (2, float))]  # noqa: B023, E731
        (ids, a), (oids, b) = inside(left), inside(right)
        (p, q), rest, others = M.matched_stretch(ids, a, oids, b, low, high, gap, 2)
        whole = {(i, o) for i, o, _ in greedy(left, right, gap)}
        sure = set(zip(ids[p].tolist(), oids[q].tolist(), strict=True))
        assert sure <= whole
        # a matched row is either settled or goes on
        for i, o in whole - sure:
            assert i not in ids or i in ids[rest]
            assert o not in oids or o in oids[others]
        settled += len(sure)
    assert settled > 500


def test_copies_of_values_are_matched_in_few_rounds(spark):
    """As pairs these would be 250,000, and each round took one of a value's."""
    left, right = [(k, 1, 5.0) for k in range(500)], [(k, 1, 5.25) for k in range(500)]
    rounds = []
    a, b = spark.createDataFrame(left, "id long, g int, a double"), spark.createDataFrame(right, "oid long, g int, b double")
    found = M.matched_on_line(a, b, "g", "a", "b", 9.0, lambda df: rounds.append(1) or written(df, "test-line"))
    assert {(x["id"], x["oid"]) for x in found.collect()} == {(k, k) for k in range(500)} and len(rounds) <= 3


def test_a_key_at_several_places_is_matched_once(spark):
    left, right = [(1, 0, 1.0), (1, 0, 5.0), (2, 0, 5.5)], [(1, 0, 5.1), (2, 0, 1.5)]
    assert matched(spark, left, right, 9.0, 20) == {(1, 1, 0.1), (2, 2, 4.0)}
