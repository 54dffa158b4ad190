"""Aggregates, sampling, ordering and row-shaping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import sample as P
from ..operators import sequence as Q
from ..operators import stats as S
from ..sources.roles import CELLS, SCORES, cells, scores, table
from .registry import query


@query("""SELECT o_orderpriority AS tool, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
 round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def dist_summary(spark, sf):
    """n, mean, interpolated quartiles and extremes of finite values."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tool"), X.finite(F.col("o_totalprice")).alias("v"))
    ranks = {f"{side}{q}": r for q in (25, 50, 75) for side, r in zip("ab", S.interpolated(q / 100), strict=True)}
    d = S.at_ranks(o, ["tool"], "v", ranks).join(o.groupBy("tool").agg(F.round(F.avg("v"), 4).alias("mean")), "tool")
    names = {25: "p25", 50: "median", 75: "p75"}
    return d.select("tool", "n", "mean", *[F.round(S.between(f"a{q}", f"b{q}", q / 100), 4).alias(c) for q, c in names.items()], "low", "high")


@query("""SELECT tool, v[CAST(floor(0.9 * (n - 1)) AS INTEGER) + 1] AS p90, v[CAST(least(n, floor(0.95 * n) + 1) AS INTEGER)] AS p95, v[CAST(floor(n / 2) AS INTEGER) + 1] AS upper_median
FROM (SELECT c_mktsegment AS tool, count(*) AS n, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1)""")
def quantile_rules(spark, sf):
    """Three rules that are not interpolated, each with its own place."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("tool"), "c_acctbal")
    ranks = {
        "p90": (0.9, lambda n: F.floor(0.9 * (n - 1)) + 1),
        "p95": (0.95, lambda n: F.least(n, F.floor(0.95 * n) + 1)),
        "upper_median": (0.5, lambda n: F.floor(n / 2) + 1),
    }
    return S.at_ranks(c, ["tool"], "c_acctbal", ranks).select("tool", *ranks)


@query(f"""WITH {SCORES} SELECT tool, round(median(value) FILTER (WHERE metric = 'mean'), 6) AS mean, round(median(value) FILTER (WHERE metric = 'top'), 6) AS top,
 round(median(value) FILTER (WHERE metric = 'users'), 6) AS users FROM scores GROUP BY tool""")
def median_table(spark, sf):
    low, high = S.interpolated(0.5)
    s = scores(spark, sf)
    m = S.at_ranks(s, ["tool", "metric"], "value", {"a": low, "b": high}).withColumn("median", F.round(S.between("a", "b", 0.5), 6))
    p = m.groupBy("tool").pivot("metric", ["mean", "top", "users"]).agg(F.first("median"))
    return s.select("tool").distinct().join(p, "tool", "left")


@query(f"""WITH {CELLS} SELECT tool, corpus, count(*) AS n, count(*) FILTER (WHERE mean IS NULL) AS failures, count(*) FILTER (WHERE users >= 3) AS passing,
 bool_and(n >= 1) AS all_measured FROM cells GROUP BY tool, corpus""")
def summarize(spark, sf):
    return cells(spark, sf).groupBy("tool", "corpus").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("mean").isNull()).alias("failures"),
        F.count_if(F.col("users") >= 3).alias("passing"),
        F.bool_and(F.col("n") >= 1).alias("all_measured"),
    )


@query("""SELECT l_returnflag AS tool, reason, n FROM (SELECT l_returnflag, l_linestatus || '/' || CAST(l_linenumber AS VARCHAR) AS reason, count(*) AS n,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linestatus || '/' || CAST(l_linenumber AS VARCHAR)) AS place FROM lineitem GROUP BY 1, 2) WHERE place <= 3""")
def top_reasons(spark, sf):
    reason = F.concat_ws("/", "l_linestatus", F.col("l_linenumber").cast("string"))
    n = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tool"), reason.alias("reason")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("tool").orderBy(F.col("n").desc(), "reason")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 3").select("tool", "reason", "n")


@query("""SELECT lang AS corpus, source AS license, count(*) AS n, CASE WHEN count(*) <= 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' WHEN count(*) <= 8 THEN '4-8' ELSE '9+' END AS bucket
FROM documents GROUP BY 1, 2""")
def licence_table(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.col("lang").alias("corpus"), F.col("source").alias("license")).agg(F.count("*").alias("n"))
    return g.withColumn("bucket", X.bucket_of(F.col("n")))


ALLOC = """st AS (SELECT lang || '|' || source AS stratum, count(*) AS size FROM documents GROUP BY 1),
b AS (SELECT stratum, size, least(2, size) AS base, size - least(2, size) AS room FROM st),
t AS (SELECT sum(room) AS all_room, greatest(0, 300 - sum(base)) AS l FROM b),
i AS (SELECT b.*, least(l, all_room) AS lft, CASE WHEN all_room > 0 THEN CAST(least(l, all_room) * room AS DOUBLE) / all_room ELSE 0 END AS ideal FROM b, t),
p AS (SELECT *, floor(ideal) AS part, row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, stratum) AS place FROM i),
alloc AS (SELECT stratum, size, CAST(base + part + CASE WHEN place <= (SELECT max(lft) - sum(part) FROM p) THEN 1 ELSE 0 END AS BIGINT) AS take FROM p)"""


def _strata(spark, sf):
    key = F.concat_ws("|", "lang", "source")
    return table(spark, sf, "documents").withColumn("stratum", key)


@query(f"WITH {ALLOC} SELECT stratum, size, take FROM alloc")
def stratified_allocate(spark, sf):
    return P.allocate(_strata(spark, sf).groupBy("stratum").agg(F.count("*").alias("size")), 300, 2)


@query(f"""WITH {ALLOC} SELECT doc_id, stratum FROM (SELECT doc_id, lang || '|' || source AS stratum,
 row_number() OVER (PARTITION BY lang || '|' || source ORDER BY sha1(CAST(doc_id AS VARCHAR))) AS place FROM documents) d JOIN alloc a USING (stratum) WHERE place <= take""")
def stratified_topk_sha1(spark, sf):
    rows = _strata(spark, sf).select("doc_id", "stratum")
    takes = P.allocate(rows.groupBy("stratum").agg(F.count("*").alias("size")), 300, 2)
    joined = rows.join(takes.select("stratum", "take"), "stratum")
    return P.top_by_hash(joined, ["stratum"], F.col("doc_id").cast("string"), F.col("take"), 300).select("doc_id", "stratum")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part""")
def round_robin(spark, sf):
    return P.round_robin(table(spark, sf, "part"), "p_brand", "p_partkey").select("p_partkey", F.col("turn").cast("long"))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return P.keep_last(e, ["user_id", "event_type"], "event_id")


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 40""")
def paged_nulls_last(spark, sf):
    """A page of a table: nulls are last whatever the direction."""
    shown = F.when(F.col("p_size") <= 40, F.col("p_retailprice"))
    return table(spark, sf, "part").orderBy(shown.desc_nulls_last(), "p_partkey").offset(40).limit(20).select("p_partkey", "p_retailprice")


@query("""WITH d AS (SELECT doc_id, n_chars, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS body FROM documents)
SELECT min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY sha1(body) HAVING count(*) > 1""")
def duplicate_bodies(spark, sf):
    body = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    d = table(spark, sf, "documents").groupBy(F.sha1(body).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return d.where("copies > 1").select("first_id", "copies")


@query("""SELECT source, count(*) AS matches FROM documents WHERE contains(lower(text || ' ' || lang), 'license') AND contains(lower(text || ' ' || lang), 'en') GROUP BY source""")
def free_text_search(spark, sf):
    """Rows whose fields hold all terms; counts by place, places without matches go."""
    fields = F.lower(F.concat_ws(" ", "text", "lang"))
    return table(spark, sf, "documents").where(fields.contains("license") & fields.contains("en")).groupBy("source").agg(F.count("*").alias("matches"))


@query("""SELECT doc_id, CASE WHEN text LIKE '%http%' THEN 'link' WHEN regexp_matches(text, '[0-9]{3}\\.[0-9]{1,3}\\.') THEN 'address' WHEN n_chars < 40 THEN 'short' END AS reason FROM documents""")
def screen(spark, sf):
    """Rejection reasons, first wins; null keeps the row."""
    t = F.col("text")
    reason = F.when(t.contains("http"), "link").when(t.rlike("[0-9]{3}\\.[0-9]{1,3}\\."), "address").when(F.col("n_chars") < 40, "short")
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason"))


FLAT_JSON = "SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id FROM events"


@query(FLAT_JSON, name="json_flatten_whole")
@query(FLAT_JSON)
def json_flatten(spark, sf):
    """Every event with its k, null where props has none."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("user_id", k.alias("k"), "event_id")


@query("""SELECT event_type, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds, mode_k, mode_n FROM events JOIN
 (SELECT event_type, k AS mode_k, n AS mode_n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n,
  row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(json_extract(props, '$.k') AS BIGINT)) AS r FROM events GROUP BY 1, 2) WHERE r = 1) USING (event_type)
GROUP BY event_type, mode_k, mode_n""")
def mode_lowest_tie(spark, sf):
    """The most frequent value, the lowest of several; and how often it occurs."""
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    n = e.groupBy("event_type", "k").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("k")).alias("low")))
    return n.groupBy("event_type").agg(F.count("k").alias("kinds"), best.alias("m")).select(
        "event_type", "kinds", (-F.col("m.low")).alias("mode_k"), F.col("m.n").alias("mode_n")
    )


@query("""SELECT p_brand, min(p_retailprice) FILTER (WHERE c >= h) AS weighted_median FROM (SELECT p_brand, p_retailprice,
 sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS c, sum(p_size) OVER (PARTITION BY p_brand) / 2.0 AS h FROM part) GROUP BY p_brand""")
def weighted_median(spark, sf):
    """The first value at which the running weight reaches half of all; equal values are added up
    before they are ordered."""
    w = Window.partitionBy("p_brand")
    p = table(spark, sf, "part").groupBy("p_brand", "p_retailprice").agg(F.sum("p_size").alias("s"))
    p = p.withColumns({"c": F.sum("s").over(w.orderBy("p_retailprice")), "h": F.sum("s").over(w) / 2.0})
    return p.where("c >= h").groupBy("p_brand").agg(F.min("p_retailprice").alias("weighted_median"))


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(60 * value) AS BIGINT) AS t FROM events),
n AS (SELECT *, CASE WHEN max(t) OVER w IS NULL OR s > max(t) OVER w + 1800 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS from_, max(t) AS to_, count(*) AS members FROM i GROUP BY user_id, island""")
def interval_islands(spark, sf):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", s.alias("s"), (s + F.floor(60 * F.col("value"))).alias("t"))
    return Q.interval_islands(e, ["user_id"], "s", "t", 1800, chunk=6 * 3600)


@query("""WITH c AS (SELECT c_nationkey AS g, c_acctbal AS v, CASE WHEN c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) > 400 THEN 1 ELSE 0 END AS new, c_custkey FROM customer),
k AS (SELECT g, v, sum(new) OVER (PARTITION BY g ORDER BY v, c_custkey ROWS UNBOUNDED PRECEDING) AS cluster FROM c)
SELECT g, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(avg(v), 6) AS centre FROM k GROUP BY g, cluster""")
def cluster_1d(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    k = Q.gap_clusters(c, ["g"], "v", 400)
    return k.groupBy("g", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("centre"))


@query("""WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, round(median(step), 6) AS median_step, count(step) AS steps FROM s GROUP BY user_id""")
def median_step(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    return Q.steps(e, ["user_id"], "at", "value").groupBy("user_id").agg(F.round(F.median("step"), 6).alias("median_step"), F.count("step").alias("steps"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pl, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE pl % CAST(ceil(n / 25.0) AS BIGINT) = 0""")
def stride_samples(spark, sf):
    return P.every_kth(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 25).select("user_id", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pl, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 12 OR floor(round(pl * 11.0 / (n - 1)) * (n - 1) / 11.0 + 0.5) = pl""")
def even_subsample(spark, sf):
    return P.even_subsample(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 12).select("user_id", "event_id")


@query("""WITH s AS (SELECT l_partkey AS k, l_suppkey AS opt, avg(l_discount) AS err, avg(l_quantity) AS nodes FROM lineitem GROUP BY 1, 2),
b AS (SELECT k, min(err) AS best FROM s GROUP BY k)
SELECT k, opt FROM (SELECT s.k, s.opt, row_number() OVER (PARTITION BY s.k ORDER BY nodes, err, opt) AS r FROM s JOIN b ON s.k = b.k AND err <= best + 0.005 + 0.2 * best) WHERE r = 1""")
def pick_winner(spark, sf):
    """The simplest candidate within a margin of the best."""
    li = table(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("opt")).agg(F.avg("l_discount").alias("err"), F.avg("l_quantity").alias("nodes"))
    best = F.min("err").over(Window.partitionBy("k"))
    near = s.withColumn("best", best).where("err <= best + 0.005 + 0.2 * best")
    return near.groupBy("k").agg(F.min_by("opt", F.struct("nodes", "err", "opt")).alias("opt"))


@query("""WITH t AS (SELECT o_orderpriority AS config, CAST(year(o_orderdate) AS BIGINT) AS round, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT config, arg_min(round, total) AS fastest, round(min(total), 2) AS least FROM t GROUP BY config""")
def fastest_round(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("config"), F.year("o_orderdate").cast("long").alias("round")).agg(F.sum("o_totalprice").alias("total"))
    return o.groupBy("config").agg(F.min_by("round", "total").alias("fastest"), F.round(F.min("total"), 2).alias("least"))


@query("""SELECT c_custkey, CAST(CASE WHEN abs(c_acctbal) >= 1000 THEN round(CAST(c_acctbal AS DECIMAL(18, 2)), 1) ELSE CAST(c_acctbal AS DECIMAL(18, 2)) END AS DOUBLE) AS v FROM customer""")
def significant_digits(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.significant(F.col("c_acctbal")).alias("v"))


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS pl, l_quantity AS v, CASE WHEN l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) THEN 0 ELSE 1 END AS new,
 l_returnflag AS f, l_partkey, l_suppkey, l_extendedprice FROM lineitem), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pl, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT k, CAST(run AS BIGINT) AS run, min(f) AS f, count(*) AS n, sum(v) AS v FROM r GROUP BY k, run""")
def merge_runs(spark, sf):
    """Adjacent rows of one style become one run."""
    w = Window.partitionBy("k").orderBy("at", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("f"), "l_partkey", "l_suppkey", "l_extendedprice"
    )
    new = F.when(F.col("f") == F.lag("f").over(w), 0).otherwise(1)
    r = li.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("k", "run").agg(F.min("f").alias("f"), F.count("*").alias("n"), F.sum("v").alias("v"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key,
 CASE WHEN instr(p_type, '/') > 0 THEN split_part(p_type, '/', 1) ELSE '' END AS corpus FROM part""")
def text_keys(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", X.slug(F.col("p_name")).alias("slug"), X.brand_key(F.col("p_brand")).alias("key"), X.corpus_of(F.col("p_type")).alias("corpus")
    )


@query("""SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM part""")
def fnv1a_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("h"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs,
 len(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS kinds, contains(html, '<script') AS scripted FROM pages""")
def markup_scan(spark, sf):
    found = lambda p, g: F.regexp_extract_all("html", F.lit(p), F.lit(g))
    return table(spark, sf, "pages").select(
        "page_id",
        F.size(found('<a [^>]*href="([^"]*)"', 1)).cast("long").alias("links"),
        F.size(found("<p[ >]", 0)).cast("long").alias("paragraphs"),
        F.size(F.array_distinct(found("<([a-z][a-z0-9]*)", 1))).cast("long").alias("kinds"),
        F.col("html").contains("<script").alias("scripted"),
    )


@query(f"""WITH {CELLS}, g AS (SELECT tool, case_id, 'fewest' AS gate, n >= 3 AS pass, CAST(n - 3 AS DOUBLE) AS headroom, true AS applies FROM cells
 UNION ALL SELECT tool, case_id, 'top', top <= 100, 100 - top, true FROM cells UNION ALL SELECT tool, case_id, 'users', users >= 2, CAST(users - 2 AS DOUBLE), NOT gt_refused FROM cells)
SELECT tool, gate, count(*) AS applicable, count(*) FILTER (WHERE pass) AS passed, round(min(headroom), 6) AS worst FROM g WHERE applies GROUP BY tool, gate""")
def gates_eval(spark, sf):
    """Gates with applicability, limit, pass and headroom, one row per gate and tool."""
    gate = lambda name, ok, room, applies: F.struct(F.lit(name).alias("gate"), ok.alias("pass"), room.cast("double").alias("headroom"), applies.alias("applies"))
    n, top, users = F.col("n"), F.col("top"), F.col("users")
    gates = F.array(gate("fewest", n >= 3, n - 3, F.lit(True)), gate("top", top <= 100, 100 - top, F.lit(True)), gate("users", users >= 2, users - 2, ~F.col("gt_refused")))
    g = cells(spark, sf).select("tool", F.explode(gates).alias("g")).where("g.applies")
    return g.groupBy("tool", F.col("g.gate").alias("gate")).agg(
        F.count("*").alias("applicable"), F.count_if(F.col("g.pass")).alias("passed"), F.round(F.min("g.headroom"), 6).alias("worst")
    )
