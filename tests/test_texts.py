"""Colours, transforms and nested values read from text, by the cases of the standards."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import colours as C
from lodestone.functions import texts as N
from lodestone.sources.scratch import written

COLOURS = [
    ("#fff", (255, 255, 255, 1)), ("#F00C", (255, 0, 0, 0.8)), ("#336699", (51, 102, 153, 1)), ("#33669980", (51, 102, 153, 128 / 255)),
    ("rebeccapurple", (102, 51, 153, 1)), (" Coral ", (255, 127, 80, 1)), ("transparent", (0, 0, 0, 0)), ("#12345", None), ("bluish", None), ("", None),
    ("rgb(255,0,51)", (255, 0, 51, 1)), ("rgb(100% 0% 20% / .5)", (255, 0, 51, 0.5)), ("rgba(300, -5, 10, 40%)", (255, 0, 10, 0.4)), ("rgb(1,2)", None),
    ("rgb(1 2 3 4)", None), ("rgb(1, 2 3)", None), ("rgb(1 2 3 /)", None), ("rgb(none 2 3)", (0, 2, 3, 1)), ("rgb(1 2 3 / 0.25)", (1, 2, 3, 0.25)),
    ("hsl(0 100% 50%)", (255, 0, 0, 1)), ("hsl(120deg, 100%, 25%)", (0, 127.5, 0, 1)), ("hsl(-120 100% 50%)", (0, 0, 255, 1)), ("hsla(.5turn 100% 50% / 10%)", (0, 255, 255, 0.1)),
    ("hsl(200grad, 50%, 50%, 1)", (63.75, 191.25, 191.25, 1)), ("hsl(3.141592653589793rad 100% 50%)", (0, 255, 255, 1)), ("var(--x)", None), (None, None),
]


def test_colours_of_the_standard(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(COLOURS)], "k int, t string")
    found = {r["k"]: r["c"] for r in df.select("k", C.css_color(F.col("t")).alias("c")).collect()}
    for k, (text, expected) in enumerate(COLOURS):
        got = found[k]
        assert (got is None) == (expected is None), text
        if expected:
            assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, expected, strict=True)), (text, got)
    assert len(C.NAMES) == 148 and all(len(v) == 6 for v in C.NAMES.values())


def test_paints(spark):
    cases = [("none", None), ("", None), ("transparent", None), ("currentColor", "#000000"), ("URL('#g1') red", "url(#g1)"), ("#abc", "#aabbcc"), ("coral !important", "#ff7f50"), ("hsl(120 100% 25%)", "#008000"), ("context-fill", "context-fill"), (None, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert {r[0]: r[1] for r in df.select("k", C.paint(F.col("t"))).collect()} == {k: p for k, (_, p) in enumerate(cases)}


def test_radial_places(spark):
    def outermost(cx, cy, r, fx, fy, x, y):
        """The largest t in steps at which the moving circle holds the point."""
        if (x, y) == (fx, fy):
            return 0.0
        gap = lambda t: math.hypot(x - fx - t * (cx - fx), y - fy - t * (cy - fy)) - r * t
        found, n = None, 200_000
        for k in range(1, n + 1):
            if (gap((k - 1) / n * 40) > 0) != (gap(k / n * 40) > 0):
                found = k / n * 40
        return min(1.0, found) if found is not None else 1.0

    cases = [(0, 0, 5, 0, 0, 3, 4), (0, 0, 5, 0, 0, 1, 1), (0, 0, 5, 2, 1, 1, 3), (0, 0, 5, 2, 1, 2, 1), (0, 0, 5, 5, 0, 4, 0.5), (0, 0, 5, 5, 0, 9, 0), (0, 0, 2, 6, 0, 3, 0.2), (0, 0, 2, 6, 0, 6, 5), (0, 0, 2, 6, 0, 5.5, 0)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "cx double, cy double, r double, fx double, fy double, x double, y double")
    found = [r[0] for r in df.select(C.radial_place(*[F.col(c) for c in df.columns])).collect()]
    assert all(abs(a - outermost(*c)) < 1e-3 for a, c in zip(found, cases, strict=True)), found


def test_transforms(spark):
    cases = [("", (3, 4)), ("translate(2)", (5, 4)), ("translate(2 -1)", (5, 3)), ("scale(2)", (6, 8)), ("scale(2,.5)", (6, 2)), ("rotate(90)", (-4, 3)), ("rotate(90 3 3)", (2, 3)), ("rotate(90,1)", (3, 4)), ("skewX(45)", (7, 4)), ("skewY(45)", (3, 7)), ("matrix(1 2 3 4 5 6)", (20, 28)), ("matrix(1 2 3)", (3, 4)), ("translate(1,0) scale(3)", (10, 12)), ("scale(3), translate(1-1)", (12, 9)), ("spin(4)", (3, 4)), ("SCALE( 2 ) translate()", (6, 8))]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").withColumn("m", N.transform(F.col("t")))
    x, y = N.applied(F.col("m"), F.lit(3.0), F.lit(4.0))
    found = {r["k"]: (r["x"], r["y"]) for r in df.select("k", x.alias("x"), y.alias("y")).collect()}
    for k, (text, expected) in enumerate(cases):
        assert all(abs(a - b) < 1e-9 for a, b in zip(found[k], expected, strict=True)), (text, found[k])


@pytest.mark.parametrize("depth", [1, 8, 9, 40])
def test_paths_at_any_depth(spark, depth):
    value, at = "/home/me/x", "$"
    for k in range(depth):
        value = {"a": value} if k % 2 else [0, value]
    for k in reversed(range(depth)):
        at += ".a" if k % 2 else "[1]"
    df = spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps({"a": "https://x"})), (3, '"file://y"'), (4, None)], "k int, j string")
    assert sorted(map(tuple, N.paths_in(df, "k", "j", lambda d: written(d, "test-paths")).collect())) == [(1, at), (3, "$")]


def test_affixes(spark):
    df = spark.createDataFrame([(' a  <b>:\t"c"/d|e? ',)], "t string")
    assert df.select(N.affix(F.col("t"))).first()[0] == "-a-bcde-"
