"""Projections of the given tables onto the engine's roles: score rows, rasters, label maps, trees.

Every function has a twin in ``CTE``: the same projection as an SQL common table expression, so that
a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, together: int, *keys: str) -> DataFrame:
    """Rows dealt by keys into tasks of about ``together``, so that a task's memory does not grow with the
    table; never into fewer than the session's shuffle partitions."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // together)), *keys)


#: Images of 8 by 8 pixels in one task, about.
VECTORS = 8192


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows in wide form: a tool is an event type, a case a quarter of a day, a corpus a week.
    Few measurements make a null; every fifth day's night has a truth that was refused."""
    ts = F.col("ts")
    day = F.date_format(ts, "yyyy-MM-dd")
    out = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("tool"),
            F.concat(day, F.lit("/"), F.floor(F.hour(ts) / 6).cast("string")).alias("case_id"),
            (F.floor((F.dayofmonth(ts) - 1) / 7)).cast("int").alias("corpus"),
            ((F.dayofmonth(ts) % 5 == 0) & (F.hour(ts) < 6)).alias("gt_refused"),
        )
        .agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            F.max("value").alias("top"),
            F.countDistinct("user_id").alias("users"),
        )
    )
    return out.withColumn("mean", F.when(F.col("n") >= 3, F.col("mean")))


CELLS = """cells AS (
  SELECT tool, case_id, corpus, gt_refused, n, CASE WHEN n >= 3 THEN mean END AS mean, top, users FROM (
    SELECT event_type AS tool,
           strftime(ts, '%Y-%m-%d') || '/' || CAST(CAST(floor(hour(ts) / 6) AS INTEGER) AS VARCHAR) AS case_id,
           CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS corpus,
           (day(ts) % 5 = 0 AND hour(ts) < 6) AS gt_refused,
           count(*) AS n, avg(value) AS mean, max(value) AS top, count(DISTINCT user_id) AS users
    FROM events GROUP BY 1, 2, 3, 4))"""

#: (metric, better, needs the truth): the catalogue that the long form is joined with.
METRICS = (("mean", "lower", False), ("top", "higher", False), ("users", "higher", True))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: (tool, case_id, corpus, gt_refused, metric, better, needs_truth, value)."""
    wide = cells(spark, sf_dir)
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(b).alias("better"), F.lit(t).alias("needs_truth"), F.col(m).cast("double").alias("value"))
            for m, b, t in METRICS
        ]
    )
    return wide.select("tool", "case_id", "corpus", "gt_refused", F.explode(entries).alias("m")).select(
        "tool", "case_id", "corpus", "gt_refused", "m.*"
    )


SCORES = (
    CELLS
    + """, scores AS (
  SELECT tool, case_id, corpus, gt_refused, 'mean' AS metric, 'lower' AS better, false AS needs_truth, CAST(mean AS DOUBLE) AS value FROM cells
  UNION ALL SELECT tool, case_id, corpus, gt_refused, 'top', 'higher', false, CAST(top AS DOUBLE) FROM cells
  UNION ALL SELECT tool, case_id, corpus, gt_refused, 'users', 'higher', true, CAST(users AS DOUBLE) FROM cells)"""
)


def pixels(spark: SparkSession, sf_dir: str, together: int = 1) -> DataFrame:
    """Rasters: an embedding is an image of 8 by 8 pixels with a level from 0 to 255 over its own
    range: (img_id, truth, x, y, v). Vectors, not pixels, are shuffled, so that windows and groups of an
    image find it in one place; with ``together`` so many of a row come with their number, ``sheet``."""
    e = table(spark, sf_dir, "embeddings")
    if together > 1:
        e = e.withColumn("sheet", F.floor(F.col("vec_id") / together))
    e = dealt(e, VECTORS, "sheet" if together > 1 else "vec_id")
    low, high = F.array_min("embedding"), F.array_max("embedding")
    sheet = ["sheet"] if together > 1 else []
    e = e.select("vec_id", "label", "embedding", low.alias("low"), high.alias("high"), *sheet)
    rows = e.select(
        F.col("vec_id").alias("img_id"), F.col("label").alias("truth"), "low", "high", *sheet, F.posexplode("embedding").alias("pos", "raw")
    )
    level = (F.col("raw").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double"))
    return rows.select(
        "img_id",
        "truth",
        (F.col("pos") % 8).alias("x"),
        F.floor(F.col("pos") / 8).cast("int").alias("y"),
        F.coalesce(F.floor(level * 255 + 0.5), F.lit(0)).cast("int").alias("v"),
        *sheet,
    )


PIXELS = """pixels AS (
  SELECT img_id, truth, pos % 8 AS x, CAST(floor(pos / 8) AS INTEGER) AS y,
         CAST(coalesce(floor((CAST(raw AS DOUBLE) - CAST(low AS DOUBLE)) / (CAST(high AS DOUBLE) - CAST(low AS DOUBLE)) * 255 + 0.5), 0) AS INTEGER) AS v
  FROM (SELECT vec_id AS img_id, label AS truth, list_min(embedding) AS low, list_max(embedding) AS high,
               unnest(embedding) AS raw, unnest(range(0, 64)) AS pos FROM embeddings))"""


def labels(spark: SparkSession, sf_dir: str, levels: int = 4) -> DataFrame:
    """Label maps: pixels in equal steps of level; the darkest tenth is transparent (-1)."""
    label = F.when(F.col("v") < 26, -1).otherwise(F.floor(F.col("v") * levels / 256)).cast("int")
    return pixels(spark, sf_dir).withColumn("label", label)


LABELS = PIXELS + ", labels_px AS (SELECT *, CAST(CASE WHEN v < 26 THEN -1 ELSE floor(v * 4 / 256.0) END AS INTEGER) AS label FROM pixels)"


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 64 by 64 pixels: an image is a sheet of 64 embeddings in eight rows, each 8 by 8
    pixels; the last sheet has holes."""
    at = F.col("img_id") % 64
    return pixels(spark, sf_dir, together=64).select(
        F.col("sheet").alias("img_id"), (at % 8 * 8 + F.col("x")).cast("int").alias("x"), (F.floor(at / 8) * 8 + F.col("y")).cast("int").alias("y"), "v"
    )


MOSAICS = PIXELS + """, mosaic AS (SELECT img_id // 64 AS img_id, CAST(img_id % 64 % 8 * 8 + x AS INTEGER) AS x, CAST(img_id % 64 // 8 * 8 + y AS INTEGER) AS y, v FROM pixels)"""


def sheet_labels(spark: SparkSession, sf_dir: str, levels: int = 4) -> DataFrame:
    """Label maps of the sheets in equal steps of level; the darkest tenth is transparent (-1)."""
    label = F.when(F.col("v") < 26, -1).otherwise(F.floor(F.col("v") * levels / 256)).cast("int")
    return mosaics(spark, sf_dir).withColumn("label", label)


SHEETS = MOSAICS + ", sheet AS (SELECT *, CAST(CASE WHEN v < 26 THEN -1 ELSE floor(v * 4 / 256.0) END AS INTEGER) AS label FROM mosaic)"
