"""Rank boards and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import stats as S
from ..sources.roles import CELLS, SCORES, cells, scores, table
from .registry import query

RANKED = (
    SCORES
    + """, complete AS (
  SELECT tool FROM scores GROUP BY tool HAVING count(DISTINCT case_id) = (SELECT count(DISTINCT case_id) FROM scores)),
kept AS (
  SELECT s.*, bool_or(gt_refused) OVER (PARTITION BY case_id, metric) AS refused, count(value) OVER (PARTITION BY case_id, metric) AS measured,
         CASE WHEN better = 'lower' THEN value ELSE -value END AS o
  FROM scores s WHERE tool IN (SELECT tool FROM complete)),
ranks AS (
  SELECT tool, case_id, metric, value,
         rank() OVER (PARTITION BY case_id, metric ORDER BY o ASC NULLS LAST) + (count(*) OVER (PARTITION BY case_id, metric, o) - 1) / 2.0 AS rank
  FROM kept WHERE measured > 0 AND NOT (needs_truth AND refused)),
board AS (
  SELECT tool, sum(s) / sum(n) AS mean_rank, avg(s / n) AS case_mean_rank, sum(n) AS cells, count(*) AS cases
  FROM (SELECT tool, case_id, sum(rank) AS s, count(*) AS n FROM ranks GROUP BY tool, case_id) GROUP BY tool)"""
)


@query(f"WITH {SCORES} SELECT tool, case_id, metric, round(value, 6) AS value FROM scores")
def score_long(spark, sf):
    return scores(spark, sf).select("tool", "case_id", "metric", F.round("value", 6).alias("value"))


@query(f"""WITH {SCORES} SELECT tool, case_id, metric,
 rank() OVER (PARTITION BY case_id, metric ORDER BY CASE WHEN better = 'lower' THEN value ELSE -value END ASC NULLS LAST)
 + (count(*) OVER (PARTITION BY case_id, metric, CASE WHEN better = 'lower' THEN value ELSE -value END) - 1) / 2.0 AS rank FROM scores""")
def rank_avg_ties(spark, sf):
    return R.average_ranks(scores(spark, sf), ["case_id", "metric"], F.col("value"), R.directed()).select("tool", "case_id", "metric", "rank")


@query(f"WITH {RANKED} SELECT tool, case_id, metric, rank FROM ranks")
def rank_complete_blocks(spark, sf):
    return R.ranked_blocks(scores(spark, sf)).select("tool", "case_id", "metric", "rank")


@query(f"WITH {RANKED} SELECT tool, round(mean_rank, 9) AS mean_rank, round(case_mean_rank, 9) AS case_mean_rank, CAST(cells AS BIGINT) AS cells, cases FROM board")
def mean_rank_board(spark, sf):
    b = R.board(R.ranked_blocks(scores(spark, sf)))
    return b.select("tool", F.round("mean_rank", 9).alias("mean_rank"), F.round("case_mean_rank", 9).alias("case_mean_rank"), "cells", "cases")


@query(f"""WITH {RANKED} SELECT metric, count(*) AS rows_ranked, count(DISTINCT case_id) AS blocks,
 (SELECT count(DISTINCT s.case_id) FROM scores s WHERE s.metric = r.metric) - count(DISTINCT case_id) AS blocks_dropped FROM ranks r GROUP BY metric""")
def dropped_blocks(spark, sf):
    all_scores = scores(spark, sf)
    there = all_scores.groupBy("metric").agg(F.countDistinct("case_id").alias("there"))
    ranked = R.ranked_blocks(all_scores).groupBy("metric").agg(F.count("*").alias("rows_ranked"), F.countDistinct("case_id").alias("blocks"))
    return ranked.join(there, "metric").select("metric", "rows_ranked", "blocks", (F.col("there") - F.col("blocks")).alias("blocks_dropped"))


@query(f"""WITH {RANKED}, pairs AS (
 SELECT a.tool, b.tool AS other, a.case_id, bool_or(a.rank < b.rank) AS better, bool_or(a.rank > b.rank) AS worse
 FROM ranks a JOIN ranks b ON a.case_id = b.case_id AND a.metric = b.metric AND a.tool <> b.tool GROUP BY 1, 2, 3)
SELECT tool, count(*) AS pairs, round(avg(CAST(better AND NOT worse AS INTEGER)), 9) AS win, round(avg(CAST(worse AND NOT better AS INTEGER)), 9) AS loss,
 round(avg(CAST(better AND worse AS INTEGER)), 9) AS incomparable, round(avg(CAST(NOT better AND NOT worse AS INTEGER)), 9) AS tie FROM pairs GROUP BY tool""")
def pareto_share(spark, sf):
    p = R.pareto(R.ranked_blocks(scores(spark, sf)))
    return p.select("tool", "pairs", *[F.round(c, 9).alias(c) for c in ("win", "loss", "incomparable", "tie")])


FRIEDMAN = """, fm AS (SELECT count(*) AS k, max(cases) AS n, sum(case_mean_rank * case_mean_rank) AS s FROM board),
 fr AS (SELECT k, n, 12.0 * n / (k * (k + 1)) * (s - k * (k + 1) * (k + 1) / 4.0) AS chi2 FROM fm)"""


def _case_means(spark, sf):
    return R.board(R.ranked_blocks(scores(spark, sf))).select("tool", F.col("case_mean_rank").alias("mean_rank"), "cases")


@query(f"WITH {RANKED} {FRIEDMAN} SELECT k, n, round(chi2, 6) AS chi2, round((n - 1) * chi2 / (n * (k - 1) - chi2), 6) AS f FROM fr")
def friedman_stat(spark, sf):
    return R.friedman(_case_means(spark, sf)).select("k", "n", F.round("chi2", 6).alias("chi2"), F.round("f", 6).alias("f"))


@query(f"""WITH {RANKED} SELECT count(*) AS k, max(cases) AS n,
 round(list_extract([{', '.join(map(str, R.NEMENYI_05))}], CAST(count(*) - 1 AS INTEGER)) * sqrt(count(*) * (count(*) + 1) / (6.0 * max(cases))), 6) AS cd FROM board""")
def nemenyi_cd(spark, sf):
    t = _case_means(spark, sf).agg(F.count("*").alias("k"), F.max("cases").alias("n"))
    return t.select("k", "n", F.round(R.critical_difference(F.col("k"), F.col("n")), 6).alias("cd"))


@query(f"""WITH {RANKED}, m AS (SELECT mean_rank, row_number() OVER (ORDER BY mean_rank, tool) AS place FROM board),
runs AS (SELECT a.place AS first, max(b.place) AS last FROM m a JOIN m b ON b.place >= a.place AND b.mean_rank - a.mean_rank < 0.15 GROUP BY a.place HAVING max(b.place) > a.place)
SELECT first, last FROM runs i WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.first <= i.first AND o.last >= i.last AND (o.first < i.first OR o.last > i.last))""")
def cd_groups(spark, sf):
    b = R.board(R.ranked_blocks(scores(spark, sf)))
    places = b.withColumn("place", F.row_number().over(Window.orderBy("mean_rank", "tool")))  # a row per tool
    return R.indistinct_groups(places, F.lit(0.15)).select(F.col("first").cast("long"), F.col("last").cast("long"))


@query(f"""WITH {CELLS}, p AS (SELECT a.case_id, a.mean AS va, b.mean AS vb FROM cells a JOIN cells b ON a.case_id = b.case_id
 WHERE a.tool = 'click' AND b.tool = 'view' AND a.mean IS NOT NULL AND b.mean IS NOT NULL)
SELECT count(*) AS n, round(avg(va - vb), 6) AS mean_diff, count(*) FILTER (WHERE va < vb) AS wins, count(*) FILTER (WHERE va > vb) AS losses, round(median(va - vb), 6) AS median_diff FROM p""")
def paired_diff(spark, sf):
    c = cells(spark, sf).where("mean IS NOT NULL")
    a = c.where("tool = 'click'").select("case_id", F.col("mean").alias("va"))
    b = c.where("tool = 'view'").select("case_id", F.col("mean").alias("vb"))
    d = F.col("d")
    pairs = a.join(b, "case_id").select(F.lit("all").alias("g"), (F.col("va") - F.col("vb")).alias("d"))
    low, high = S.interpolated(0.5)
    middle = S.at_ranks(pairs, ["g"], "d", {"a": low, "b": high}).select(F.round(S.between("a", "b", 0.5), 6).alias("median_diff"))
    sums = pairs.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"))
    return sums.join(F.broadcast(middle), how="left")  # one row each


@query(f"""WITH {CELLS}, p AS (SELECT a.case_id, b.mean - a.mean AS fx, a.users - b.users AS fy FROM cells a JOIN cells b ON a.case_id = b.case_id
 WHERE a.tool = 'click' AND b.tool = 'view' AND a.mean IS NOT NULL AND b.mean IS NOT NULL)
SELECT case_id, round(fx, 6) AS fx, CAST(fy AS DOUBLE) AS fy FROM p WHERE fx * fy < 0 ORDER BY abs(fx * fy) DESC, case_id LIMIT 6""")
def disagreement_topk(spark, sf):
    """The six cases where two metrics disagree most about two tools."""
    c = cells(spark, sf).where("mean IS NOT NULL")
    a = c.where("tool = 'click'").select("case_id", F.col("mean").alias("ma"), F.col("users").alias("ua"))
    b = c.where("tool = 'view'").select("case_id", F.col("mean").alias("mb"), F.col("users").alias("ub"))
    p = a.join(b, "case_id").select("case_id", (F.col("mb") - F.col("ma")).alias("fx"), (F.col("ua") - F.col("ub")).cast("double").alias("fy"))
    top = p.where(F.col("fx") * F.col("fy") < 0).orderBy(F.abs(F.col("fx") * F.col("fy")).desc(), "case_id").limit(6)
    return top.select("case_id", F.round("fx", 6).alias("fx"), "fy")


@query("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
j AS (SELECT a.k, a.v AS x, b.v AS y FROM (SELECT * FROM y WHERE yr = 1996) a JOIN (SELECT * FROM y WHERE yr = 1997) b ON a.k = b.k)
SELECT c_mktsegment AS segment, count(*) AS common, count(*) FILTER (WHERE abs(x - y) > 0.5 * greatest(abs(x), abs(y))) AS changed
FROM j JOIN customer ON k = c_custkey GROUP BY 1""")
def run_diff(spark, sf):
    """Two runs (years) joined by key; changed beyond a relative tolerance."""
    v = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("v"))
    j = v.where("yr = 1996").select("k", F.col("v").alias("x")).join(v.where("yr = 1997").select("k", F.col("v").alias("y")), "k")
    far = F.abs(F.col("x") - F.col("y")) > 0.5 * F.greatest(F.abs("x"), F.abs("y"))
    named = j.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k")
    return named.groupBy("segment").agg(F.count("*").alias("common"), F.count_if(far).alias("changed"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb, CASE WHEN a.k IS NULL THEN 'only b' WHEN b.k IS NULL THEN 'only a' WHEN a.n = b.n THEN 'same' ELSE 'moved' END AS verdict
FROM a FULL JOIN b ON a.k = b.k""")
def one_sided_pairs(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    a = o.where("yr = 1996").select("k", F.col("n").alias("na"))
    b = o.where("yr = 1997").select("k", F.col("n").alias("nb"))
    verdict = F.when(F.col("na").isNull(), "only b").when(F.col("nb").isNull(), "only a").when(F.col("na") == F.col("nb"), "same").otherwise("moved")
    return a.join(b, "k", "full").select("k", "na", "nb", verdict.alias("verdict"))


@query()
def paired_bootstrap(spark, sf):
    """Means with seeded intervals; the generator has no SQL form, tests hold it to a plain loop."""
    c = cells(spark, sf).where("mean IS NOT NULL")
    return S.bootstrap(c.withColumn("mean", F.round("mean", 9)), ["tool"], "mean", "case_id")


@query()
def paired_order_interval(spark, sf):
    c = cells(spark, sf).where("mean IS NOT NULL")
    return S.ordered_interval(c.withColumn("mean", F.round("mean", 9)), ["tool"], "mean", "case_id")
