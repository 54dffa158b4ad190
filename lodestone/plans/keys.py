"""Queries of keys, names, transforms, style sheets and arguments read from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import texts as N
from ..sources.roles import CELLS, cells, table
from ..sources.scratch import written
from .registry import query

FNV = """format('{{:08x}}', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295))"""


@query(f"SELECT p_partkey, {FNV.format('p_name')} AS hash FROM part")
def fnv1a_keys(spark, sf):
    """32-bit FNV-1a of each name, as eight hexadecimal digits."""
    return table(spark, sf, "part").select("p_partkey", F.lower(F.lpad(F.hex(X.fnv1a(F.col("p_name"))), 8, "0")).alias("hash"))


@query(f"""WITH v AS (SELECT vec_id, string_agg(CAST(floor(CAST(x AS DOUBLE) * 10 + 0.5) AS BIGINT)::VARCHAR, ',' ORDER BY i) AS t FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1)
SELECT vec_id, {FNV.format('t')} AS signature FROM v""")
def geometry_signature(spark, sf):
    """A fingerprint of coordinates, which are rounded to a tenth first."""
    tenths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10 + 0.5).cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.lower(F.lpad(F.hex(X.fnv1a(F.array_join(tenths, ","))), 8, "0")).alias("signature"))


@query("""SELECT o_orderkey AS id, sha1(o_orderpriority || '/' || o_orderkey) AS rank_key, least(o_custkey, o_orderkey) || ':' || greatest(o_custkey, o_orderkey) AS crossing_key, 'v1:' || o_orderstatus || ':' || o_custkey || ':' || o_orderpriority AS cache_key,
 CASE WHEN o_orderkey < 1000 THEN 'n<1K' WHEN o_orderkey < 10000 THEN '1K<n<10K' WHEN o_orderkey < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS size_category FROM orders""")
def row_keys(spark, sf):
    """Keys of ordering, of an unordered pair and of a cache, and a size class."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        k.alias("id"),
        F.sha1(F.concat_ws("/", p, k.cast("string"))).alias("rank_key"),
        F.concat_ws(":", F.least(k, c).cast("string"), F.greatest(k, c).cast("string")).alias("crossing_key"),
        F.concat_ws(":", F.lit("v1"), "o_orderstatus", c.cast("string"), p).alias("cache_key"),
        F.when(k < 1000, "n<1K").when(k < 10_000, "1K<n<10K").when(k < 100_000, "10K<n<100K").otherwise("100K<n<1M").alias("size_category"),
    )


@query("""WITH t AS (SELECT p_partkey AS id, ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN '  <v2>:' WHEN 1 THEN '/x|y' WHEN 2 THEN chr(9) || 'a?*' ELSE '-icon.svg' END AS text, p_size AS w, 1 + p_size % 9 AS h FROM part)
SELECT id, regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*' || chr(1) || '-' || chr(31) || ']', '', 'g'), '[\\s]+', '-', 'g') AS affix,
 CASE WHEN text LIKE '%-icon.svg' THEN 'symbol' WHEN w / h::DOUBLE >= 2 THEN 'wordmark' ELSE 'symbol' END AS kind, CASE WHEN text LIKE '%.svg' THEN 'https://example.org/runs/' ELSE 'renders/' END || id AS place FROM t""")
def names_and_kinds(spark, sf):
    """Affixes made safe for file names, the kind of a drawing by suffix or shape, and where it lies."""
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "  <v2>:").when(k % 4 == 1, "/x|y").when(k % 4 == 2, "\ta?*").otherwise("-icon.svg")
    t = table(spark, sf, "part").select(k.alias("id"), F.concat(F.lit(" "), "p_name", tail).alias("text"), F.col("p_size").alias("w"), (1 + F.col("p_size") % 9).alias("h"))
    place = F.concat(F.when(F.col("text").endswith(".svg"), "https://example.org/runs/").otherwise("renders/"), F.col("id").cast("string"))
    return t.select("id", N.affix(F.col("text")).alias("affix"), N.kind(F.col("text"), F.col("w"), F.col("h")).alias("kind"), place.alias("place"))


@query(f"""WITH {CELLS}, t AS (SELECT DISTINCT tool, corpus FROM cells), f AS (SELECT * FROM (VALUES ('click', 'headline'), ('view', 'headline'), ('error', 'reference')) AS v(tool, family))
SELECT t.tool, t.corpus, CASE WHEN corpus = 3 THEN 'line' ELSE 'fill' END AS kind, CASE WHEN corpus NOT IN (1, 2) THEN 'in-sample' WHEN corpus = 2 THEN 'seen in development' ELSE 'held out' END AS status,
 (regexp_matches(t.tool, '-swept$|^abl-') OR coalesce(family IN ('ablation', 'reference'), false)) AS ablation FROM t LEFT JOIN f ON f.tool = t.tool""")
def corpus_views(spark, sf):
    """What a corpus's numbers stand for, how it is ranked, and which tools are analyses only."""
    info = spark.createDataFrame([("click", "headline"), ("view", "headline"), ("error", "reference")], "tool string, family string")
    corpora = F.col("corpus")
    t = cells(spark, sf).select("tool", "corpus").distinct().join(F.broadcast(info), "tool", "left")
    status = F.when(~corpora.isin(1, 2), "in-sample").when(corpora == 2, "seen in development").otherwise("held out")
    ablation = F.col("tool").rlike("-swept$|^abl-") | F.coalesce(F.col("family").isin("ablation", "reference"), F.lit(False))
    return t.select("tool", "corpus", F.when(corpora == 3, "line").otherwise("fill").alias("kind"), status.alias("status"), ablation.alias("ablation"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, radians(p_size * 3) AS t FROM part),
m AS (SELECT k, CASE k % 4 WHEN 0 THEN [2.0, 0, 0, 2, s, 0] WHEN 1 THEN [cos(t) * 2, sin(t) * 2, -sin(t) * 0.5, cos(t) * 0.5, 3, s] ELSE [1.0, 0, 0, 1, 0, 0] END AS m, s, t FROM p WHERE k % 4 <> 2)
SELECT k, round(m[1] * 5 + m[3] * 7 + m[5], 6) AS x, round(m[2] * 5 + m[4] * 7 + m[6], 6) AS y FROM m
UNION ALL SELECT k, round(4 + cos(t) * (5 * 1.5 - 4) - sin(t) * (7 - 9), 6), round(9 + sin(t) * (5 * 1.5 - 4) + cos(t) * (7 - 9), 6) FROM p WHERE k % 4 = 2""")
def transformed_points(spark, sf):
    """The point (5, 7) under lists of transforms read from text, applied from the right."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("translate("), s, F.lit(") scale(2)")))
        .when(k % 4 == 1, F.concat(F.lit("translate(3,"), s, F.lit(") rotate("), (F.col("p_size") * 3).cast("string"), F.lit("),scale(2 .5)")))
        .when(k % 4 == 2, F.concat(F.lit("rotate("), (F.col("p_size") * 3).cast("string"), F.lit(" 4 9) matrix(1.5 0 0 1 0 0) scale()")))
        .otherwise(F.lit("spin(3)"))
    )
    p = table(spark, sf, "part").select(k.alias("k"), N.transform(text).alias("m"))
    x, y = N.applied(F.col("m"), F.lit(5.0), F.lit(7.0))
    return p.select("k", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT p_partkey AS k, regexp_replace(round(CAST(p_size / 7.0 AS DOUBLE), 2)::VARCHAR, '\\.0$', '') AS first_, 3 AS numbers FROM part""")
def rounded_coordinates(spark, sf):
    """Coordinates of a path rounded to two places; a blank stands where two numbers would touch."""
    s = F.col("p_size")
    text = F.concat(F.lit("M"), (s / 7.0).cast("string"), F.lit("-3.10001.5"))
    r = N.rounded(text, 2)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), r.alias("r"))
    first = F.regexp_extract("r", r"^M(.*?)-3\.1 0\.5$", 1)
    return p.select("k", first.alias("first_"), F.size(F.regexp_extract_all("r", F.lit(r"[0-9.]+"), F.lit(0))).cast("long").alias("numbers"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k, 0 AS ord, 'p' || s AS selector, 1 AS specificity, 'fill' AS name, '#0' || s AS value, false AS important FROM p UNION ALL SELECT k, 0, 'p' || s, 1, 'stroke', 'red', true FROM p
 UNION ALL SELECT k, 1, '.c' || s || '#i', 10100, 'fill', '#0' || s, false FROM p UNION ALL SELECT k, 1, '.c' || s || '#i', 10100, 'stroke', 'red', true FROM p UNION ALL SELECT k, 2, 'a.b', 101, 'margin', '0', false FROM p""")
def stylesheet_rules(spark, sf):
    """Declarations of each style sheet by selector, with order, weight and importance."""
    s = F.col("p_size").cast("string")
    css = F.concat(F.lit("@charset 'x'; /* a{b:c} */ p"), s, F.lit(" , .c"), s, F.lit("#i { FILL : #0"), s, F.lit(" ; stroke:red !important ; broken }\n a.b{margin:0}"))
    r = N.rules(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), css.alias("css")), "css")
    weight = F.expr("10000 * weight.ids + 100 * weight.classes + weight.elements")
    return r.select("k", "ord", "selector", weight.alias("specificity"), "name", "value", "important")


@query("""SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_size END AS n, p_size % 2 = 0 AS flag, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'a=b' END AS rest FROM part""")
def call_arguments(spark, sf):
    """Arguments key=value as typed columns; what is not given is null, and a value may hold a sign of equality."""
    size = F.col("p_size")
    pairs = F.concat(
        F.when(size > 25, F.concat(F.lit("n="), size.cast("string"), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("flag="), (size % 2 == 0).cast("string"), F.lit("\nname="), "p_name",
        F.when(size % 3 == 0, F.lit("\nrest=a=b")).otherwise(F.lit("")),
    )
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), N.arguments(pairs).alias("a"))
    get = lambda name: F.try_element_at("a", F.lit(name))
    return a.select("k", get("n").cast("int").alias("n"), get("flag").cast("boolean").alias("flag"), get("name").alias("name"), get("rest").alias("rest"))


@query("""WITH d AS (SELECT conv_id, turn, text FROM conversations), h AS (SELECT role, count(*) FILTER (WHERE text LIKE '%the%') AS hits, count(*) AS n FROM conversations GROUP BY 1) SELECT role, hits, n FROM h WHERE hits > 0""")
def searched_elsewhere(spark, sf):
    """Matches of a search in each place, places without any left out."""
    h = table(spark, sf, "conversations").groupBy("role").agg(F.count_if(F.col("text").contains("the")).alias("hits"), F.count("*").alias("n"))
    return h.where("hits > 0")


@query("""SELECT event_id, '$' || CASE event_id % 3 WHEN 0 THEN '.meta.path' WHEN 1 THEN '.files[1]' END AS at FROM events WHERE event_id % 3 < 2""")
def local_paths(spark, sf):
    """Where a value of nested rows holds a path of the local machine."""
    k = F.col("event_id")
    home, web = F.lit("/home/me/x.png"), F.lit("https://example.org/x.png")
    meta = F.struct(F.when(k % 3 == 0, home).otherwise(web).alias("path"))
    files = F.array(web, F.when(k % 3 == 1, home).otherwise(web))
    rows = table(spark, sf, "events").select("event_id", F.to_json(F.struct(meta.alias("meta"), files.alias("files"))).alias("props"))
    return N.paths_in(rows, "event_id", "props", lambda df: written(df, "local-paths"))
