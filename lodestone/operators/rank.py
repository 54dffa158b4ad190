"""Ranking of tools over complete blocks, Pareto shares and the statistics that follow from them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Studentised range at 0.05 divided by the square root of two, for 2 to 21 tools.
NEMENYI_05 = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544, 3.569)
#: The same at level 0.10.
NEMENYI_10 = (1.645, 2.052, 2.291, 2.459, 2.589, 2.693, 2.780, 2.855, 2.920, 2.978, 3.030, 3.077, 3.120, 3.159, 3.196, 3.230, 3.261, 3.291, 3.319, 3.346)


def average_ranks(cells: DataFrame, block: list[str], value: Column, order: Column) -> DataFrame:
    """Adds ``rank``: 1 for the best in its block, ties at their mean place, nulls tied last.
    ``order`` is least for the best and null where ``value`` is."""
    w = Window.partitionBy(*block)
    tied = Window.partitionBy(*block, "__order")
    rows = cells.withColumn("__order", order)
    place = F.rank().over(w.orderBy(F.col("__order").asc_nulls_last()))
    return rows.withColumn("rank", place + (F.count(F.lit(1)).over(tied) - 1) / 2.0).drop("__order")


def directed(value: str = "value", better: str = "better") -> Column:
    return F.when(F.col(better) == "lower", F.col(value)).otherwise(-F.col(value))


def complete_tools(scores: DataFrame) -> DataFrame:
    """Tools with a row for every case. Both counts are small aggregates."""
    cases = scores.agg(F.countDistinct("case_id").alias("cases"))
    return scores.groupBy("tool").agg(F.countDistinct("case_id").alias("own")).join(F.broadcast(cases)).where("own = cases").select("tool")


def ranked_blocks(scores: DataFrame) -> DataFrame:
    """Ranks over (case, metric) blocks of the complete tools. A block goes if its metric needs a
    truth that was refused, or if no tool has a value."""
    kept = scores.join(F.broadcast(complete_tools(scores)), "tool", "left_semi")
    w = Window.partitionBy("case_id", "metric")
    kept = kept.withColumns({"refused": F.bool_or("gt_refused").over(w), "measured": F.count("value").over(w)})
    kept = kept.where((F.col("measured") > 0) & ~(F.col("needs_truth") & F.col("refused")))
    return average_ranks(kept, ["case_id", "metric"], F.col("value"), directed()).select("tool", "case_id", "metric", "value", "rank")


def board(ranks: DataFrame) -> DataFrame:
    """Mean rank over blocks and over case means, per tool."""
    by_case = ranks.groupBy("tool", "case_id").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    return by_case.groupBy("tool").agg(
        (F.sum("s") / F.sum("n")).alias("mean_rank"),
        F.avg(F.col("s") / F.col("n")).alias("case_mean_rank"),
        F.sum("n").alias("cells"),
        F.count("*").alias("cases"),
    )


def pareto(ranks: DataFrame) -> DataFrame:
    """Shares of (case, opponent) pairs that a tool wins, loses, ties, or that cannot be compared."""
    a = ranks.select("case_id", "metric", F.col("tool").alias("tool"), F.col("rank").alias("ra"))
    b = ranks.select("case_id", "metric", F.col("tool").alias("other"), F.col("rank").alias("rb"))
    pairs = (
        a.join(b, ["case_id", "metric"])
        .where(F.col("tool") != F.col("other"))
        .groupBy("tool", "other", "case_id")
        .agg(F.bool_or(F.col("ra") < F.col("rb")).alias("better"), F.bool_or(F.col("ra") > F.col("rb")).alias("worse"))
    )
    share = lambda c: F.avg(c.cast("double"))
    b_, w_ = F.col("better"), F.col("worse")
    return pairs.groupBy("tool").agg(
        F.count("*").alias("pairs"),
        share(b_ & ~w_).alias("win"),
        share(w_ & ~b_).alias("loss"),
        share(b_ & w_).alias("incomparable"),
        share(~b_ & ~w_).alias("tie"),
    )


def friedman(case_means: DataFrame) -> DataFrame:
    """Chi square and F of mean ranks ``mean_rank`` over ``n`` blocks; F is infinite where its
    denominator is not positive."""
    total = case_means.agg(F.count("*").alias("k"), F.max("cases").alias("n"), F.sum(F.pow("mean_rank", F.lit(2))).alias("s"))
    k, n = F.col("k"), F.col("n")
    chi = 12.0 * n / (k * (k + 1)) * (F.col("s") - k * F.pow(k + 1, F.lit(2)) / 4.0)
    rows = total.withColumn("chi2", chi)
    below = n * (k - 1) - F.col("chi2")
    f = F.when(below <= 1e-12, F.lit(float("inf"))).otherwise((n - 1) * F.col("chi2") / below)
    return rows.select("k", "n", "chi2", f.alias("f"))


def critical_difference(k: Column, n: Column, values: tuple[float, ...] | None = None) -> Column:
    q = F.try_element_at(F.array(*[F.lit(x) for x in values or NEMENYI_05]), (k - 1).cast("int"))
    return F.when((k >= 2) & (k <= 21), q * F.sqrt(k * (k + 1) / (6.0 * n)))


def indistinct_groups(means: DataFrame, limit: Column) -> DataFrame:
    """Maximal runs of at least two tools in the order of mean rank that differ by less than
    ``limit``; runs inside another go. The frame is the number of tools, not of rows."""
    m = means.select("place", "mean_rank")
    runs = (
        m.alias("a")
        .join(m.alias("b"), (F.col("b.place") >= F.col("a.place")) & (F.col("b.mean_rank") - F.col("a.mean_rank") < limit))
        .groupBy(F.col("a.place").alias("first"))
        .agg(F.max("b.place").alias("last"))
        .where("last > first")
    )
    inner, outer = runs.alias("i"), runs.alias("o")
    inside = (F.col("o.first") <= F.col("i.first")) & (F.col("o.last") >= F.col("i.last")) & (
        (F.col("o.first") < F.col("i.first")) | (F.col("o.last") > F.col("i.last"))
    )
    return inner.join(outer, inside, "left_anti")


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi square distribution, by the series or the continued fraction of the
    incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution, by the continued fraction of the incomplete beta function."""
    if f == math.inf:
        return 0.0
    if f <= 0:
        return 1.0
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def with_tails(tests: DataFrame) -> DataFrame:
    """Adds p_chi2 and p_f to rows of ``friedman``, of which there is one; null without ranks."""

    def tails(chi2: float | None, f: float | None, k: int, n: int | None) -> tuple | None:
        if chi2 is None or f is None or not n or k < 2:
            return None
        return chi2_tail(chi2, k - 1.0), f_tail(f, k - 1.0, (k - 1.0) * (n - 1.0))

    return tests.withColumn("t", F.udf(tails, "p_chi2 double, p_f double")("chi2", "f", "k", "n")).select("*", "t.*").drop("t")


def ln_gamma(c: Column) -> Column:
    """Natural logarithm of the gamma function."""

    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(math.lgamma, na_action="ignore")

    return f(c)
