"""Published fixtures and plain versions of what SQL does not state."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import geometry as G
from lodestone.operators import rank as R
from lodestone.operators import sample as P
from lodestone.operators import spatial as D
from lodestone.operators import stats as S
from lodestone.sources.scratch import written
from lodestone.streaming import boards as B

SCORE = "tool string, case_id string, metric string, better string, needs_truth boolean, gt_refused boolean, value double"


@pytest.mark.parametrize(
    "values,better,ranks",
    [
        ([3, 1, 2], "lower", [3, 1, 2]),
        ([3, 1, 2], "higher", [1, 3, 2]),
        ([1, 1, 2, 5], "lower", [1.5, 1.5, 3, 4]),
        ([None, 2, None, 1], "lower", [3.5, 2, 3.5, 1]),
        ([0.1, None], "higher", [1, 2]),
    ],
)
def test_average_ranks(spark, values, better, ranks):
    rows = [(f"t{i}", "c", "m", better, False, False, None if v is None else float(v)) for i, v in enumerate(values)]
    out = R.average_ranks(spark.createDataFrame(rows, SCORE), ["case_id", "metric"], F.col("value"), R.directed())
    assert [r["rank"] for r in out.orderBy("tool").collect()] == ranks


def test_mean_ranks_over_complete_blocks(spark):
    de = {("a", 1): 1.0, ("b", 1): 2.0, ("c", 1): 3.0, ("a", 2): 2.0, ("b", 2): 1.0, ("c", 2): None}
    dino = {("a", 1): 0.9, ("b", 1): 0.9, ("c", 1): 0.8, ("a", 2): 0.7, ("b", 2): 0.8, ("c", 2): None}
    rows = [(t, f"c/{c}", "de", "lower", False, False, v) for (t, c), v in de.items()]
    rows += [(t, f"c/{c}", "dino", "higher", False, False, v) for (t, c), v in dino.items()]
    rows += [("late", "c/1", "de", "lower", False, False, 0.0)]
    board = {r["tool"]: r["mean_rank"] for r in R.board(R.ranked_blocks(spark.createDataFrame(rows, SCORE))).collect()}
    assert board == {"a": 6.5 / 4, "b": 5.5 / 4, "c": 3.0}


def test_refused_truth_drops_the_block(spark):
    rows = []
    for case, refused in ((1, False), (2, True)):
        for tool, v in (("a", 1.0), ("b", 2.0)):
            rows += [(tool, str(case), "de", "lower", False, refused and tool == "a", v), (tool, str(case), "chamfer", "lower", True, refused and tool == "a", v)]
    out = R.ranked_blocks(spark.createDataFrame(rows, SCORE)).select("case_id", "metric").distinct().collect()
    assert sorted(map(tuple, out)) == [("1", "chamfer"), ("1", "de"), ("2", "de")]


def test_pareto(spark):
    rows = []
    for case, cells in ((1, {"a": (1, 0.9), "b": (2, 0.5), "c": (3, 0.6)}), (2, dict.fromkeys("abc", (1, 0.9)))):
        for tool, (de, dino) in cells.items():
            rows += [(tool, str(case), "de", "lower", False, False, float(de)), (tool, str(case), "dino", "higher", False, False, dino)]
    got = {r["tool"]: r for r in R.pareto(R.ranked_blocks(spark.createDataFrame(rows, SCORE))).collect()}
    assert [got["a"][c] for c in ("pairs", "win", "loss", "incomparable", "tie")] == [4, 0.5, 0, 0, 0.5]
    assert [got["b"][c] for c in ("win", "loss", "incomparable", "tie")] == [0, 0.25, 0.25, 0.5]


def test_friedman_and_tails(spark):
    means = spark.createDataFrame([(t, m, 14) for t, m in zip("abcd", (3.143, 2.0, 2.893, 1.964), strict=True)], "tool string, mean_rank double, cases long")
    row = R.friedman(means).first()
    assert abs(row["chi2"] - 9.28) < 0.01 and abs(row["f"] - 3.69) < 0.01
    assert 0.01 < R.f_tail(row["f"], 3, 39) < 0.05
    sure = spark.createDataFrame([("a", 1.0, 2), ("b", 2.0, 2)], "tool string, mean_rank double, cases long")
    assert R.friedman(sure).first()["f"] == math.inf and R.f_tail(math.inf, 1, 1) == 0
    assert abs(R.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(R.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    assert abs(R.chi2_tail(4.5, 2) - math.exp(-2.25)) < 1e-12
    assert abs(R.f_tail(4.964603, 1, 10) - 0.05) < 1e-6


def test_critical_difference_and_groups(spark):
    kn = spark.createDataFrame([(4, 14), (1, 14), (22, 14)], "k long, n long")
    cd = [r[0] for r in kn.select(R.critical_difference(F.col("k"), F.col("n"))).collect()]
    assert abs(cd[0] - 1.25) < 0.005 and cd[1:] == [None, None]
    for means, limit, expected in (([1, 1.5, 2.6, 2.8, 5], 1.2, {(0, 1), (1, 2), (2, 3)}), ([1, 1.2, 1.4, 4], 1, {(0, 2)})):
        m = spark.createDataFrame([(i, float(v)) for i, v in enumerate(means)], "place long, mean_rank double")
        assert {(r["first"], r["last"]) for r in R.indistinct_groups(m, F.lit(float(limit))).collect()} == expected


def test_distribution_and_quantile_rules(spark):
    v = spark.createDataFrame([(3.0,), (1.0,), (float("nan"),), (2.0,)], "v double").select(X.finite(F.col("v")).alias("v"))
    row = v.agg(*S.distribution(F.col("v"))).first()
    assert (row["n"], row["median"], row["low"], row["high"]) == (3, 2, 1, 3)
    ten = spark.range(1, 11).selectExpr("'a' g", "cast(id as double) v")
    assert S.at_ranks(ten, ["g"], "v", {"p": S.floored(0.95)}).first()["p"] == 9.0


def test_order_statistics_of_large_groups(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=30_000), rng.integers(0, 5, 5_000)])
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", float(i)) for i in range(7)] + [("b", None)], "g string, v double")
    ranks = {"p95": (0.95, lambda n: F.least(n, F.floor(0.95 * n) + 1)), "mid": (0.5, lambda n: F.floor(n / 2) + 1)}
    got = {r["g"]: r for r in S.at_ranks(rows, ["g"], "v", ranks).collect()}
    s = np.sort(values)
    assert (got["a"]["n"], got["a"]["p95"], got["a"]["mid"]) == (35_000, s[int(0.95 * 35_000)], s[17_500])
    assert (got["b"]["n"], got["b"]["p95"], got["b"]["mid"], got["b"]["high"]) == (7, 6, 3, 6)


def test_generator_and_bootstrap(spark):
    def plain(seed, n):
        out = []
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
            t = (seed ^ seed >> 15) * (seed | 1) & 0xFFFFFFFF
            t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
            out.append(((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296)
        return out

    assert S.mulberry(0x5EED, 500).tolist() == plain(0x5EED, 500)
    rows = spark.createDataFrame([("t", f"{i:03}", 2 + i % 3 * 0.01) for i in range(30)], "tool string, case_id string, d double")
    a, b = (S.bootstrap(rows, ["tool"], "d", "case_id").first() for _ in range(2))
    assert a == b and 2 < a["low"] < a["mean"] < a["high"]
    row = S.ordered_interval(rows, ["tool"], "d", "case_id").first()
    assert row["low"] <= row["high"]


@pytest.mark.parametrize("sizes,total,floor", [({"a": 1000, "b": 100, "c": 2}, 100, 4), ({"a": 1000, "b": 100, "c": 2}, 5000, 4)])
def test_allocation(spark, sizes, total, floor):
    out = P.allocate(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), total, floor)
    take = {r["stratum"]: r["take"] for r in out.collect()}
    assert sum(take.values()) == min(total, sum(sizes.values())) and take["c"] == 2
    assert all(take[k] <= sizes[k] for k in sizes) and take["b"] >= floor and take["a"] > take["b"]


def test_slug_and_hash(spark):
    df = spark.createDataFrame([("Café & Bar!",), ("---",), ("x" * 60,), ("alpha beta " * 8,)], "s string")
    got = [r[0] for r in df.select(X.slug(F.col("s"))).collect()]
    assert got[:3] == ["cafe-and-bar", None, "x" * 48] and len(got[3]) <= 48 and not got[3].endswith("-")

    def plain(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    assert [r[0] for r in df.select(X.fnv1a(F.col("s"))).collect()] == [plain(r["s"]) for r in df.collect()]


def test_colours(spark):
    row = spark.range(1).select(X.channels_to_hex(F.lit(300), F.lit(-4), F.lit(15.6)), X.contrast(X.luminance(F.lit(0), F.lit(0), F.lit(0)), X.luminance(F.lit(255), F.lit(255), F.lit(255))), *X.lab(F.lit(255), F.lit(255), F.lit(255))).first()
    assert row[0] == "#ff0010" and abs(row[1] - 21) < 1e-9 and abs(row[2] - 100) < 1e-3 and abs(row[3]) < 0.01 and abs(row[4]) < 0.02


def test_matching_is_greedy(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b), float(rng.integers(0, 20))) for a in range(12) for b in range(12) if rng.random() < 0.5]
    out = {(r["id"], r["oid"]) for r in D.mutual_best(spark.createDataFrame(pairs, "id long, oid long, gap double"), lambda df: written(df, "test")).collect()}
    left, right, expected = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), expected.add((a, b))
    assert out == expected


def test_geometry_of_one_image():
    ink = np.zeros((9, 9), int)
    ink[2:7, 2:7] = 1
    d = G.squared_distances(ink)
    assert d[4, 4] == 9 and d[2, 2] == 1 and d[0, 0] == 0
    bar = np.zeros((7, 20), int)
    bar[2:5, 2:18] = 1
    thin = G.thin(bar)
    assert thin.any() and thin.sum(axis=0).max() == 1
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    areas = sorted(G.signed_area(np.array(loop, float)) for loop in G.outlines(ring))
    assert areas == [-1, 25]
    line = np.stack([np.linspace(0, 9, 10), np.zeros(10)], axis=1)
    assert len(G.simplified(line, 0.1)) == 2
    control = np.array([[0, 0], [1, 3], [4, 3], [5, 0]], float)
    _, error = G.fit_cubic(G.bezier(control, np.linspace(0, 1, 40)), rounds=20)
    assert error < 0.05


def test_stream_counts_repeated_events_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    events.where("event_id < 600").coalesce(1).write.mode("append").parquet(source)
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(source)
    cells = B.windowed_cells(B.event_stream(spark, source), late="60 days")
    q = cells.writeStream.outputMode("update").foreachBatch(B.upsert_latest(spark, target)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = B.latest_cells(spark, target)
    plain = events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").start.alias("case_start"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("t"))
    a = sorted(map(tuple, got.select("case_start", "tool", "n", F.round("total", 6)).collect()))
    assert a == sorted(map(tuple, plain.collect()))
    done = events.where("event_id < 990").select(B.content_key("event_id", "value").alias("key"))
    assert B.pending(events.withColumn("key", B.content_key("event_id", "value")), done, ["key"]).count() == 10
