"""Vector codes and hard negatives against plain loops."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pytest

from lodestone.llm import hard_negatives as H
from lodestone.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def table(spark, rows):
    """With a column whose name is one of the result's."""
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def random_rows(seed, n, dim, odd=True, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * 0.2 if levels is None else rng.integers(0, levels, (n, dim)) / 8
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    if odd:
        rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [math.nan] * dim, 1), (n + 3, [math.inf] * dim, 2), (n + 4, [0.5] * dim, None), (None, [0.25] * dim, 1)]
        rows += [rows[3], rows[3], (n + 5, [1e30] * dim, 3)]
    return rows


def clean(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def grid(v, scale):
    return [max(-(1 << 27), min(1 << 27, math.floor(float(np.float32(x)) * scale))) for x in v]


def codes_by_loop(rows, rounds=6, parts=8, entries=16):
    kept = [(i, grid(v, 4096), label) for i, v, label in rows if clean(v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    w = dim // parts
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    first = [least[i] for i in sorted(least)[:entries]]
    books = [[v[p * w : (p + 1) * w] for v in first] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                groups.setdefault(nearest(p, x)[0], []).append(x)
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(p, v[p * w : (p + 1) * w]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for j, _ in found), sum(d for _, d in found), label))
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("seed,n,dim,levels", [(0, 90, 16, None), (1, 60, 64, 3), (2, 9, 8, 2), (3, 40, 12, None)])
def test_codes_equal_a_loop(spark, seed, n, dim, levels):
    rows = random_rows(seed, n, dim, levels=levels)
    found = sorted((tuple(r) for r in V.vector_codes(table(spark, rows).repartition(3)).collect()), key=str)
    assert found == codes_by_loop(rows)


def test_codes_of_unequal_lengths_and_of_no_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0] * 9, 0), (3, [], None)]
    assert sorted((tuple(r) for r in V.vector_codes(table(spark, rows)).collect()), key=str) == codes_by_loop(rows)
    assert V.vector_codes(table(spark, rows).limit(0)).collect() == []
    assert V.vector_codes(table(spark, [(1, None, 2)])).collect() == []


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_LABELS", 1)
    rows = random_rows(5, 50, 8)
    assert sorted((tuple(r) for r in V.vector_codes(table(spark, rows)).collect()), key=str) == codes_by_loop(rows)


def test_cells_leave_out_entries_but_never_the_nearest(monkeypatch):
    monkeypatch.setattr(V, "MEMO", 50)
    rng = np.random.default_rng(0)
    entries = rng.integers(-3000, 3000, (16, 2))
    cells = V.Cells(entries, 1024)
    for k in range(5):
        x = rng.integers(-4000, 4000, (300, 2)) if k else np.repeat(rng.integers(-(2**27), 2**27, (30, 2)), 10, axis=0)
        bits = cells(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        kept = (bits[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(1)
        ties = d == d.min(axis=1, keepdims=True)
        assert (kept[ties] == 1).all() and len(cells.keys) <= 350
        assert (cells.keys[1:] > cells.keys[:-1]).all()
    assert kept.mean() < 0.5


def mined_by_loop(rows, every=50, n_pos=5, n_neg=3):
    part = [(i, grid(v, 256), label) for i, v, label in rows if i is not None and label is not None and clean(v)]
    out = set()
    for a, x, label in part:
        if a % every:
            continue
        scored = {(-sum(p * q for p, q in zip(x, v, strict=False)), i, m == label) for i, v, m in part if i != a}
        for s, i, _ in sorted(r for r in scored if r[2])[:n_pos]:
            inside = [(t, j) for t, j, same in sorted(scored) if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside[:n_neg])}
    return out


@pytest.mark.parametrize("seed,n,dim,levels,every", [(0, 300, 8, None, 50), (1, 200, 16, 2, 7), (2, 120, 4, 3, 1), (3, 80, 64, None, 3)])
def test_mined_equals_a_loop(spark, monkeypatch, seed, n, dim, levels, every):
    monkeypatch.setattr(H, "BLOCK", 40)  # several blocks, and rows in several pieces
    monkeypatch.setattr(H, "ROWS", 33)
    rows = random_rows(seed, n, dim, levels=levels)
    found = [tuple(r) for r in H.hard_negatives(table(spark, rows).repartition(3), every=every).collect()]
    assert set(found) == mined_by_loop(rows, every) and len(found) == len(set(found))


def test_bounds_spare_rows_and_lose_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (4, 16))
    grid = np.concatenate([c + rng.integers(-3, 4, (30, 16)) for c in centres])
    rows = np.concatenate([c + rng.integers(-3, 4, (200, 16)) for c in centres])
    tree = H.Tree(np.arange(len(grid)), np.zeros(len(grid), int), grid)
    assert sorted(tree.ids) == list(range(len(grid))) and (tree.parent[1:] < np.arange(1, len(grid))).all()
    whole = tree.grid @ rows.T
    low = np.sort(whole, axis=1)[:, -20]
    scored = 0
    for k, at, exact in tree.scores(rows, lambda k: (np.ones(len(rows), bool), low[k], np.inf)):
        scored += len(at)
        assert (exact == whole[k, at]).all()
        assert set(np.flatnonzero(whole[k] >= low[k])) <= set(at)
    assert scored < 0.6 * whole.size


def test_nothing_to_mine(spark):
    assert H.hard_negatives(table(spark, random_rows(0, 20, 4)).limit(0)).collect() == []
    assert H.hard_negatives(table(spark, [(50, [1.0], 1), (51, None, 1), (52, [], 2)])).collect() == []
