"""Steps whose batches and groups stay bounded, whatever their input."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestone.operators import geometry as G
from lodestone.queries import QUERIES
from lodestone.sources import drawings as D


def test_items_of_many_documents_are_handed_on_in_bounded_batches():
    long = "M0 0" + "L1 1 2 3" * 1000
    docs = pa.RecordBatch.from_pydict({"k": pa.array(range(60)), "svg": pa.array([f'<svg><path d="{long}"/><line id="q" x2="{k}"/></svg>' for k in range(60)])})
    found = list(D._items_of(iter([docs])))
    assert max(len(b.column("segments").flatten()) for b in found) <= D.MOST + 2001
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["k"], r["item"]) for r in rows] == [(k, i) for k in range(60) for i in (0, 1)]
    assert {len(r["segments"]) for r in rows} == {2000, 1}
    assert [r["segments"][0]["p"][6] for r in rows[1::2]] == [float(k) for k in range(60)]


def test_drawings_of_one_small_file_are_read_in_several_tasks(spark):
    assert QUERIES["drawn_items"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_corners_are_split_as_points_are():
    r = random.Random(3)
    for n in (1, 2, 5, 40, 300):
        for tolerance in (0.0, 0.75, 2.5):
            points = [(r.randrange(20), r.randrange(20)) for _ in range(n)]
            points.append(points[0])
            kept = G.simplified(np.array(points, dtype=float), tolerance)
            assert G._simplified_corners(points, tolerance) == [tuple(map(int, p)) for p in kept]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def in_files(spark, folder: str, name: str, n: int = 3) -> str:
    """A table in several files, so that no step finds it in one partition by chance."""
    spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(n).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_strokes_shuffle_their_vectors_alone(spark, tmp_path):
    found = plan(QUERIES["stroke_coverage"](spark, in_files(spark, str(tmp_path), "embeddings")))
    dealt = [line for line in found.splitlines() if "Exchange" in line]
    assert len(dealt) == 3 and all("REPARTITION_BY_NUM" in line and "vec_id" in line for line in dealt)


def test_chains_of_one_length_are_fitted_together(monkeypatch):
    calls, fit = [], G.fit_cubics
    monkeypatch.setattr(G, "fit_cubics", lambda p, *a: calls.append(p.shape) or fit(p, *a))
    r = random.Random(4)
    chains = [[{"x": float(k), "y": r.uniform(0, 9)} for k in range(4 + c % 3)] for c in range(30)]
    chains += [[{"x": 1.0, "y": 1.0}] * 5, [{"x": 0.0, "y": float(k % 2)} for k in range(6)]]
    batch = pa.RecordBatch.from_pydict({"g": pa.array(range(32), pa.int64()), "chain": pa.array(chains, pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()})))})
    rows = {x["g"]: x for b in G._fitted(iter([batch])) for x in b.to_pylist()}
    assert len(calls) == 3 and len(rows) == 32
    for g, chain in enumerate(chains):
        control, error = G.fit_cubic(np.array([[p["x"], p["y"]] for p in chain]))
        assert rows[g]["n"] == len(chain) and np.allclose(rows[g]["control"], control.reshape(-1)) and np.isclose(rows[g]["error"], error)
    assert rows[30]["error"] < 1e-9


def test_nearest_meets_few_places_of_a_crowded_plane(spark, monkeypatch):
    from lodestone.operators import spatial as S
    from lodestone.sources.scratch import written

    r = random.Random(9)
    places = [(round(r.gauss(0, 1), 3), round(r.gauss(0, 1), 3)) for _ in range(600)] + [(0.5, 0.5)] * 300 + [(40.0, -3.0)]
    points = [(k, *p) for k, p in enumerate([(round(r.gauss(0, 1), 3), round(r.gauss(0, 1), 3)) for _ in range(150)] + [(0.5, 0.5)] * 50 + [(-30.0, 9.0)])]
    met, near = [], S._near
    monkeypatch.setattr(S, "_near", lambda *a: met.append(near(*a).count()) or near(*a))
    o = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "oid long, ox double, oy double")
    found = S.nearest(spark.createDataFrame(points, "id long, x double, y double"), o, 8.0, [], lambda df: written(df, "test-nearest"))
    rows = {x["id"]: x["oid"] for x in found.collect()}
    expected = {k: min((round((x - u) ** 2 + (y - v) ** 2, 12), j) for j, (u, v) in enumerate(places))[1] for k, x, y in points}
    assert rows == expected
    # all pairs of the plane are 181,000
    assert sum(met) < 20_000
