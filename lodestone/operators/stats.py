"""Aggregates with the exact quantile, median and tie rules; pairing and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floored(q: float):
    """The place floor(q (n - 1)), from 1: the rule for ``at_ranks`` that does not interpolate."""
    return (q, lambda n: F.floor(F.round(q * (n - 1), 9)) + 1)


#: Groups up to this size are selected from whole.
SMALL_GROUP = 10_000


def at_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict, margin: float = 0.005) -> DataFrame:
    """Exact order statistics of large groups: per group n, low, high, and for each name of ``ranks``
    the value at that place of the ascending order; nulls do not count. ``ranks`` maps a name to
    (share, function of n that gives the place from 1).

    A sketch with a proven rank error brackets each place, so only about twice ``margin`` of a
    group's rows are ordered, after equal values were counted together; no group is collected.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"))
    shares = [q for q, _ in ranks.values()]
    ends = [max(0.0, q - margin) for q in shares] + [min(1.0, q + margin) for q in shares]
    stats = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", ends, 10_000).alias("ends")
    )
    k, n = len(shares), F.col("n")
    want = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                place(n).cast("long").alias("place"),
                F.when(n <= SMALL_GROUP, F.col("low")).otherwise(F.col("ends")[i]).alias("from_"),
                F.when(n <= SMALL_GROUP, F.col("high")).otherwise(F.col("ends")[k + i]).alias("to_"),
            )
            for i, (_, place) in enumerate(ranks.values())
        ]
    )
    stats = stats.withColumn("want", want)
    counted = rows.groupBy(*group, "v").agg(F.count("*").alias("c"))
    near = counted.join(stats.select(*group, "want"), group)
    below = [F.sum(F.when(F.col("v") < F.col("want")[i]["from_"], F.col("c")).otherwise(0)).alias(f"b{i}") for i in range(k)]
    inside = F.filter("want", lambda w: (F.col("v") >= w["from_"]) & (F.col("v") <= w["to_"]))
    hits = near.withColumn("w", F.explode(inside)).select(*group, "v", "c", F.col("w.i").alias("i"), F.col("w.place").alias("place"))
    base = near.groupBy(*group).agg(*below)
    w = Window.partitionBy(*group, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("run", F.sum("c").over(w)).join(base, group)
    under = F.element_at(F.array(*[F.col(f"b{i}") for i in range(k)]), F.col("i") + 1)
    found = hits.where(F.col("run") + under >= F.col("place")).groupBy(*group).agg(
        *[F.min(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(ranks)]
    )
    return stats.select(*group, "n", "low", "high").join(found, group)


def interpolated(q: float):
    """The two places between which quantile ``q`` lies, and its value from them."""
    place = lambda n: q * (n - 1)
    return (q, lambda n: F.floor(F.round(place(n), 9)) + 1), (q, lambda n: F.ceil(F.round(place(n), 9)) + 1)


def between(low: str, high: str, q: float) -> Column:
    at = F.round(q * (F.col("n") - 1), 9)
    return F.col(low) + (at - F.floor(at)) * (F.col(high) - F.col(low))


def distribution(value: Column) -> list[Column]:
    """n, mean, interpolated quartiles and extremes of the finite values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        q[0].alias("p25"),
        q[1].alias("median"),
        q[2].alias("p75"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


def mulberry(seed: int, n: int) -> np.ndarray:
    """n draws in [0, 1) of the 32-bit generator whose state steps by a constant, so that draw i has
    a closed form and all are made at once."""
    m = np.uint64(0xFFFFFFFF)
    state = (np.uint64(seed) + np.uint64(0x6D2B79F5) * np.arange(1, n + 1, dtype=np.uint64)) & m
    t = ((state ^ (state >> np.uint64(15))) * (state | np.uint64(1))) & m
    t ^= (t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & m)) & m
    return ((t ^ (t >> np.uint64(14))) & m).astype(np.float64) / 4294967296.0


def resampled_means(values: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Sorted means of resamples of the values, in blocks of rounds so that memory is bounded."""
    n = len(values)
    draws = mulberry(seed, rounds * n).reshape(rounds, n)
    return np.sort(values[np.minimum((draws * n).astype(np.int64), n - 1)].mean(axis=1))


def bootstrap(frame: DataFrame, group: list[str], value: str, order: str, rounds: int = 2000, seed: int = 0x5EED) -> DataFrame:
    """Per group the mean with a 95 % interval of resampled means, quantiles interpolated. The values
    of a group are one per case, a few thousand at most; groups are spread over tasks."""
    schema = ", ".join(f"{c} string" for c in group) + ", n long, mean double, low double, high double"

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        v = v[np.isfinite(v)]
        row = dict(zip(group, map(str, keys), strict=True)) | {"n": len(v), "mean": np.nan, "low": np.nan, "high": np.nan}
        if len(v):
            means = resampled_means(v, rounds, seed)
            row |= {"mean": v.mean(), "low": np.quantile(means, 0.025), "high": np.quantile(means, 0.975)}
        return pd.DataFrame([row])

    return frame.groupBy(*group).applyInPandas(run, schema)


def ordered_interval(frame: DataFrame, group: list[str], value: str, order: str, rounds: int = 4000, seed: int = 1) -> DataFrame:
    """The other interval: order statistics of resampled means at floor and ceiling places."""
    schema = ", ".join(f"{c} string" for c in group) + ", n long, low double, high double"

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        means = resampled_means(v, rounds, seed)
        low, high = means[int(0.025 * rounds)], means[min(rounds - 1, int(np.ceil(0.975 * rounds)) - 1)]
        return pd.DataFrame([dict(zip(group, map(str, keys), strict=True)) | {"n": len(v), "low": low, "high": high}])

    return frame.groupBy(*group).applyInPandas(run, schema)


