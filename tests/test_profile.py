"""Splitting of profiles and stops by least squares against plain numpy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import profile as P
from lodestone.sources.scratch import written


def keep(df):
    return written(df, "test-profile")


def split_by_stack(points, tolerance):
    kept, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        t = (points[a + 1 : b, 0] - points[a, 0]) / (points[b, 0] - points[a, 0])
        away = np.abs(points[a, 1:] + t[:, None] * (points[b, 1:] - points[a, 1:]) - points[a + 1 : b, 1:]).sum(axis=1)
        k = int(away.argmax())
        if away[k] > tolerance:
            kept.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return kept


def test_splits_equal_a_stack(spark):
    rng = np.random.default_rng(0)
    lines = {g: np.column_stack([np.linspace(0, 1, n), rng.integers(0, 40, (n, 2))]) for g, n in ((1, 200), (2, 2), (3, 3), (5, 60))}
    lines[4] = np.array([[0.5, 3, 3]])
    rows = [(g, 10 * i, *map(float, r)) for g, p in lines.items() for i, r in enumerate(p)]
    out = P.split(spark.createDataFrame(rows, "g int, i int, t double, a double, b double"), ["g"], ["a", "b"], lambda p, c: F.abs(p[0] - c[0]) + F.abs(p[1] - c[1]), 25.0, keep)
    found: dict[int, set] = {}
    for r in out.collect():
        found.setdefault(r["g"], set()).add(r["i"] // 10)
    assert found == {g: split_by_stack(p, 25.0) for g, p in lines.items()}


def test_stops_equal_least_squares(spark):
    r = random.Random(2)
    profiles = {1: [0.1, 0.3, 0.31, 0.8, 0.97], 2: [0.2, 0.9], 3: [0.4], 4: [0.0, 0.5, 1.0]}
    samples = {g: [(r.random() ** 2, r.uniform(40, 200), r.uniform(40, 200)) for _ in range(300)] for g in profiles}
    samples[4] = [(t * 0.4, a, b) for t, a, b in samples[4]]  # no sample near the last stop
    start = {g: [(t, 100.0 + 10 * i, 90.0) for i, t in enumerate(ts)] for g, ts in profiles.items()}
    out = P.stops(
        spark.createDataFrame([(g, *s) for g, rows in samples.items() for s in rows], "g int, t double, a double, b double"),
        spark.createDataFrame([(g, i, *s) for g, rows in start.items() for i, s in enumerate(rows)], "g int, i int, t double, a double, b double"),
        ["g"],
        ["a", "b"],
    )
    found: dict[int, list] = {}
    for row in sorted(out.collect(), key=lambda x: x["j"]):
        found.setdefault(row["g"], []).append((row["t"], row["a"], row["b"]))
    for g, rows in samples.items():
        first = np.array(start[g] * (2 if len(start[g]) == 1 else 1))
        at = first[:, 0].copy()
        at[0], at[-1] = 0, 1
        x = np.array(rows)
        hats = np.array([np.interp(x[:, 0], at, np.eye(len(at))[k]) for k in range(len(at))]).T
        held = np.sqrt(1e-6 * len(x)) * np.eye(len(at))
        for c in (1, 2):
            best = np.linalg.lstsq(np.vstack([hats, held]), np.concatenate([x[:, c], held @ first[:, c]]), rcond=None)[0]
            np.testing.assert_allclose([s[c] for s in found[g]], np.clip(best, 0, 255), atol=1e-6)
        np.testing.assert_allclose([s[0] for s in found[g]], at)
