"""Stratified allocation, hash-ranked samples, round robin and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(strata: DataFrame, total: int, floor: int) -> DataFrame:
    """Adds ``take`` to (stratum, size): each stratum's floor, then proportional shares of the rest
    by largest remainder, ties by key, never more than the size. The frame has a row per stratum.

    The proportional part is of what is left of the strata beyond their floors, so no share passes
    its size."""
    base = F.least(F.lit(floor), F.col("size"))
    rows = strata.withColumn("base", base).withColumn("room", F.col("size") - base)
    sums = rows.agg(F.sum("room").alias("all_room"), F.greatest(F.lit(0), F.lit(total) - F.sum("base")).alias("left"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    left = F.least("left", "all_room")
    ideal = F.when(F.col("all_room") > 0, left * F.col("room") / F.col("all_room")).otherwise(0.0)
    rows = rows.withColumns({"part": F.floor(ideal), "rest": ideal - F.floor(ideal), "left": left})
    spare = F.max("left").over(Window.partitionBy()) - F.sum("part").over(Window.partitionBy())
    order = Window.orderBy(F.round("rest", 9).desc(), "stratum")
    extra = (F.row_number().over(order) <= spare).cast("long")
    return rows.withColumn("take", F.col("base") + F.col("part") + extra).select("stratum", "size", "take")


def top_by_hash(rows: DataFrame, stratum: list[str], key: Column, take: Column, most: int) -> DataFrame:
    """Per stratum the first rows in the order of sha1 of their key. No stratum takes more than
    ``most``; as a constant it lets tasks drop rows before the shuffle, however large a stratum is."""
    place = F.row_number().over(Window.partitionBy(*stratum).orderBy(F.sha1(key)))
    return rows.withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= take))


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """A place for each row such that every prefix is balanced over the groups."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn)


def every_kth(rows: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """Per group every ceil(n / cap)-th row from the first."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumns({"at": at, "step": F.ceil(n / cap)}).where("at % step = 0")


def even_subsample(rows: DataFrame, group: list[str], order: str, cap: int) -> DataFrame:
    """Per group at most ``cap`` rows at even places, both ends among them."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    # row at is place round(i (n - 1) / (cap - 1)) of some i
    i = F.round(F.col("at") * (cap - 1) / (F.col("n") - 1))
    keep = (F.col("n") <= cap) | (F.floor(i * (F.col("n") - 1) / (cap - 1) + 0.5) == F.col("at"))
    return rows.withColumns({"at": at, "n": n}).where(keep)


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Later rows overwrite earlier ones of the same key, by a map-side combined maximum."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
