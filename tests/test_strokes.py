"""Stroke graphs and closed tours against loops in plain Python."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import skeleton as S
from lodestone.operators.tour import cheapest_tours
from lodestone.sources.scratch import written


def keep(df):
    return written(df, "test-strokes")


def all_tours(m, arcs, joints):
    """The least (cost, arcs) over every closed sequence of arcs."""
    best = None

    def on(seam, first, pos, smooth, cost, used):
        nonlocal best
        if pos == m:
            total = cost + joints[seam][0 if smooth and first else 1]
            best = min(best or (total, len(used)), (total, len(used)))
            return
        for k, (start, n, price, si, so) in enumerate(arcs):
            if start == (seam + pos) % m and pos + n <= m:
                meet = 0 if not used else joints[start][0 if smooth and si else 1]
                on(seam, first if used else si, pos + n, so, cost + meet + price, [*used, k])

    for seam in range(m):
        on(seam, None, 0, None, 0, [])
    return best


def test_tours_equal_trying_all(spark):
    r = random.Random(0)
    loops = {}
    for g in range(25):
        m = r.randint(1, 6)
        arcs = [(r.randrange(m), r.randint(1, min(3, m)), r.randint(1, 20), r.random() < 0.5, r.random() < 0.5) for _ in range(r.randint(1, 14))]
        loops[g] = (m, arcs, [(r.randint(0, 9), r.randint(0, 9)) for _ in range(m)])
    schema = "g int, m int, arcs array<struct<start:int,len:int,cost:long,smooth_in:boolean,smooth_out:boolean>>, joints array<struct<smooth:long,corner:long>>"
    out = cheapest_tours(spark.createDataFrame([(g, *x) for g, x in loops.items()], schema)).collect()
    expected = {g: all_tours(*x) for g, x in loops.items()}
    assert {r["g"]: (r["cost"], r["n"]) for r in out} == {g: b for g, b in expected.items() if b}
    for row in out:
        m, arcs, _ = loops[row["g"]]
        spans = sorted((arcs[k][0], arcs[k][1]) for k in row["arcs"])
        covered = sorted((s + d) % m for s, n in spans for d in range(n))
        assert covered == list(range(m)) and len(spans) == row["n"]


def pruned_by_loop(nodes, edges):
    """edges: id -> [a, b, len, tip_a, tip_b, parts, closed]."""
    edges = {k: [*v, 1, False] for k, v in edges.items()}
    while True:
        changed = False
        for k, (a, b, length, ta, tb, _, closed) in list(edges.items()):
            if closed or (a is None) == (b is None):
                continue
            r, tip = nodes[b if a is None else a], (ta if a is None else tb) or 0.0
            if length < 1.5 * r + 1.5 and not (length > r + 1 and tip >= 0.75 * r):
                del edges[k]
                changed = True
        for node, r in nodes.items():
            at = [(k, s) for k, e in edges.items() for s in (0, 1) if e[s] == node and not e[6]]
            if len(at) == 1:
                (k, s), changed = at[0], True
                edges[k][s], edges[k][3 + s] = None, r
            elif len(at) == 2:
                (k, s), (q, t) = at
                changed = True
                if k == q:
                    edges[k][0] = edges[k][1] = None
                    edges[k][6] = True
                    continue
                e, f = edges.pop(k), edges.pop(q)
                edges[min(k, q)] = [e[1 - s], f[1 - t], e[2] + f[2], e[4 - s], f[4 - t], e[5] + f[5], False]
        if not changed:
            return edges


def plain(a, b):
    return tuple(sorted((x is not None, x or 0) for x in (a, b)))


@pytest.mark.parametrize("seed", [0, 1])
def test_pruning_equals_a_loop(spark, seed):
    r = random.Random(seed)
    nodes = {n: r.choice([1.0, 2.0, 4.0]) for n in range(90)}
    edges = {}
    for k in range(110):
        a, b = r.randrange(90), r.choice([None, *range(90)] if r.random() < 0.7 else [None])
        edges[k] = [a, b, float(r.randint(1, 12)), None, r.choice([None, 0.5, 2.0, 4.0]) if b is None else None]
    edges[200] = [None, None, 3.0, 1.0, 1.0]
    chain = [300 + i for i in range(40)]
    nodes |= {n: 1.0 for n in chain}
    edges |= {500 + i: [chain[i], chain[(i + 1) % 40], 2.0, None, None] for i in range(40)}
    schema = "id long, a long, b long, len double, tip_a double, tip_b double"
    out = S.prune_spurs(spark.createDataFrame(list(nodes.items()), "id long, r double"), spark.createDataFrame([(k, *e) for k, e in edges.items()], schema), keep).collect()
    found = {x["id"]: (plain(x["a"], x["b"]), x["len"], x["parts"], x["closed"]) for x in out}
    assert len(found) == len(out)
    assert found == {k: (plain(e[0], e[1]), e[2], e[5], e[6]) for k, e in pruned_by_loop(nodes, edges).items()}
    assert found[500] == (plain(None, None), 80.0, 40, True)


def test_contraction_equals_a_loop(spark):
    r = random.Random(3)
    nodes = {n: r.choice([0.5, 1.0, 3.0, 6.0]) for n in range(120)}
    edges = {k: (r.randrange(120), r.choice([None, *range(120)]), float(r.randint(1, 9))) for k in range(130)}
    cluster, radius = {n: n for n in nodes}, dict(nodes)
    while True:
        link = next((k for k, (a, b, n) in edges.items() if b is not None and a != b and cluster[a] != cluster[b] and n <= 0.6 * max(radius[cluster[a]], radius[cluster[b]]) + 1), None)
        if link is None:
            break
        a, b = sorted((cluster[edges[link][0]], cluster[edges[link][1]]))
        radius[a] = max(radius[a], radius[b])
        cluster = {n: a if c == b else c for n, c in cluster.items()}
    held, left = S.contract_links(spark.createDataFrame(list(nodes.items()), "id long, r double"), spark.createDataFrame([(k, *e) for k, e in edges.items()], "id long, a long, b long, len double"), keep)
    assert {x["id"]: (x["cluster"], x["r"]) for x in held.collect()} == {n: (c, radius[c]) for n, c in cluster.items()}
    stay = {k: (cluster[a], None if b is None else cluster[b]) for k, (a, b, n) in edges.items() if b is None or a == b or n > 0.6 * radius[cluster[a]] + 1 or cluster[a] != cluster[b]}
    assert {x["id"]: (x["a"], x["b"]) for x in left.collect()} == stay


def test_ids_are_linked_within_and_over_blocks(spark):
    """The same components for any block; all in one block take a single table."""
    from lodestone.operators.spatial import linked_ids

    pairs, seen = [(1, 2), (2, 9), (9, 10), (17, 30), (30, 31), (31, 17), (50, 50)], []

    def keep(df):
        seen.append(df)
        return df.localCheckpoint()

    def found(**how):
        nodes = sorted({k for p in pairs for k in p} | {40, 41})
        return dict(map(tuple, linked_ids(spark.createDataFrame(pairs, "id long, oid long"), spark.createDataFrame([(k,) for k in nodes], "id long"), keep, **how).collect()))

    whole = found(block=1000)
    assert len(seen) == 1 and whole == found() == found(block=8) == found(block=1)
    assert whole == {1: 1, 2: 1, 9: 1, 10: 1, 17: 17, 30: 17, 31: 17, 40: 40, 41: 41, 50: 50}


@pytest.mark.parametrize("block", [1 << 20, 40, 7])
def test_pruning_within_and_over_blocks(spark, block):
    """Images of 40 edge numbers are pruned to their end in one pass, and otherwise as a loop does it; how
    edges run is the same for any block."""
    r, nodes, edges, seen = random.Random(9), {}, {}, []
    for g in range(12):
        mine = [100 * g + k for k in range(14)]
        nodes |= {n: r.choice([1.0, 2.0, 4.0]) for n in mine}
        for k in range(18):
            a, b = r.choice(mine), r.choice([None, *mine])
            edges[40 * g + k] = [a, b, float(r.randint(1, 12)), None, r.choice([None, 0.5, 2.0, 4.0]) if b is None else None]
        edges |= {40 * g + 20 + k: [mine[-1] + 1 + k, mine[-1] + 1 + (k + 1) % (g + 1), 2.0, None, None] for k in range(g + 1)}
        nodes |= {mine[-1] + 1 + k: 1.0 for k in range(g + 1)}
    edges[1000] = [None, None, 3.0, 1.0, 1.0]

    def once(df):
        seen.append(df)
        return keep(df)

    def found(how, checkpoint):
        schema = "id long, a long, b long, len double, tip_a double, tip_b double"
        return S.prune_spurs(spark.createDataFrame(list(nodes.items()), "id long, r double"), spark.createDataFrame([(k, *e) for k, e in edges.items()], schema), checkpoint, block=how).collect()

    out = found(block, once)
    assert {x["id"]: (plain(x["a"], x["b"]), x["len"], x["parts"], x["closed"]) for x in out} == {k: (plain(e[0], e[1]), e[2], e[5], e[6]) for k, e in pruned_by_loop(nodes, edges).items()}
    assert (len(seen) == 1) == (block >= 40)
    if block < 40:
        assert sorted(map(str, out)) == sorted(map(str, found(40, keep)))
