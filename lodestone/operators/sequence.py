"""Operators over ordered rows: islands, gap clusters, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(rows: DataFrame, keys: list[str], slack: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("from_", "to_")
    reach = F.max("to_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("from_") > reach + slack)).cast("int")
    rows = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_"), F.sum("members").alias("members"))


def interval_islands(rows: DataFrame, group: list[str], start: str, end: str, slack: float = 0, chunk: float | None = None) -> DataFrame:
    """Merged intervals: a new island starts after a gap of more than ``slack``. With ``chunk``
    intervals are merged first among those that start in one stretch of that length, so that a group
    with very many rows is shared out, and only its islands meet in the end."""
    rows = rows.select(*group, F.col(start).alias("from_"), F.col(end).alias("to_"), F.lit(1).cast("long").alias("members"))
    if chunk:
        rows = _merged(rows.withColumn("__chunk", F.floor(F.col("from_") / chunk)), [*group, "__chunk"], slack).drop("__chunk", "island")
    return _merged(rows, group, slack)


def gap_clusters(rows: DataFrame, group: list[str], value: str, gap: float) -> DataFrame:
    """One-dimensional clusters: neighbours within ``gap`` of each other belong together."""
    w = Window.partitionBy(*group).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return rows.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))


def steps(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    return rows.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(order)))


def box_smooth(rows: DataFrame, group: list[str], order: str, value: str, passes: int) -> DataFrame:
    """Passes of the 1-2-1 kernel along each chain; ends stay."""
    w = Window.partitionBy(*group).orderBy(order)
    for _ in range(passes):
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        rows = rows.withColumn(value, F.coalesce((before + 2 * F.col(value) + after) / 4, F.col(value)))
    return rows


def turns(rows: DataFrame, group: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the turn in degrees at each inner point of a polyline and the length of the step to it."""
    w = Window.partitionBy(*group).orderBy(order)
    ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    turn = F.abs(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))
    return rows.withColumns({"length": F.sqrt(ax * ax + ay * ay), "turn": turn})


def resampled(rows: DataFrame, group: list[str], order: str, step: float) -> DataFrame:
    """Points at even arc length along each polyline, from its first point."""
    w = Window.partitionBy(*group).orderBy(order)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    seg = rows.withColumns({"nx": nx, "ny": ny}).where("nx is not null")
    length = F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2)))
    seg = seg.withColumn("len", length)
    seg = seg.withColumn("done", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("done") - F.col("len"))
    first = F.ceil(F.round(F.col("before") / step, 9)).cast("long")
    last = F.ceil(F.round(F.col("done") / step, 9)).cast("long") - 1
    k = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    pts = seg.where("len > 0").withColumn("k", k)
    t = (F.col("k") * step - F.col("before")) / F.col("len")
    return pts.select(*group, "k", (F.col("x") + t * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("y"))
