"""Queries that take every row of their tables."""

from __future__ import annotations

import numpy as np

from lodestone.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_flatten_schema_whole_has_every_row(spark):
    kinds = {r["kind"]: r["count"] for r in QUERIES["flatten_schema_whole"](spark, SF).groupBy("kind").count().collect()}
    assert kinds == {"order": rows(spark, "orders").count(), "part": rows(spark, "part").count(), "customer": rows(spark, "customer").count()}


def test_edge_crossings_whole_equals_a_loop(spark):
    at = {r["vec_id"]: tuple(map(float, r["embedding"][:2])) for r in rows(spark, "embeddings").collect()}
    s = {i: (*at[i], *at[i + 1]) for i in at if i + 1 in at}

    def side(a, x, y):
        return np.sign((a[2] - a[0]) * (y - a[1]) - (a[3] - a[1]) * (x - a[0]))

    def cross(a, b):
        return side(a, *b[:2]) * side(a, *b[2:]) < 0 and side(b, *a[:2]) * side(b, *a[2:]) < 0

    expected = {(i, j) for i in s for j in s if i < j and cross(s[i], s[j])}
    found = [(r["id"], r["oid"]) for r in QUERIES["edge_crossings_whole"](spark, SF).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert {i % 5 for i, _ in found} == set(range(5))


def test_json_flatten_whole_has_every_event(spark, tmp_path):
    assert QUERIES["json_flatten_whole"](spark, SF).count() == rows(spark, "events").count()
    few = [(1, 10, '{"k": 7}'), (2, 11, '{"k": 8}'), (3, 12, '{"x": 1}'), (4, 13, None)]
    spark.createDataFrame(few, "event_id long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["user_id"], r["k"], r["event_id"]) for r in QUERIES["json_flatten_whole"](spark, str(tmp_path)).collect()}
    assert found == {(10, 7, 1), (11, 8, 2), (12, None, 3), (13, None, 4)}
