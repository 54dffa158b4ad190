"""Clustering of points around a few centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres are compared with every point, so their number is checked.
MOST_CENTRES = 4096


def assign_nearest(points: DataFrame, centres: DataFrame, axes: list[str]) -> DataFrame:
    """Adds ``c``: the nearest centre of (c, axes...), the lowest of several. The centres travel as
    one array beside each point, so nothing is joined."""
    rows = centres.select("c", *axes).limit(MOST_CENTRES + 1).collect()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    table = F.array(*[F.struct(*[F.lit(float(r[a])).alias(a) for a in axes], F.lit(r["c"]).alias("c")) for r in sorted(rows, key=lambda r: r["c"])])

    def cost(c):
        total = sum((F.pow(F.col(a) - c[a], F.lit(2)) for a in axes), F.lit(0.0))
        return F.struct(F.round(total, 12).alias("d"), c["c"].alias("c"))

    return points.withColumn("c", F.array_min(F.transform(table, cost))["c"])


def lloyd(points: DataFrame, axes: list[str], k: int, rounds: int) -> DataFrame:
    """Rounds of Lloyd's method from the ``k`` points with the lowest ids; only the centres, k rows,
    come to the driver between rounds."""
    first = points.orderBy("id").limit(k).select("id", *axes).collect()
    spark = points.sparkSession
    schema = "c long, " + ", ".join(f"{a} double" for a in axes)
    centres = spark.createDataFrame([(i, *[r[a] for a in axes]) for i, r in enumerate(first)], schema)
    for i in range(rounds):
        assigned = assign_nearest(points, centres, axes)
        if i + 1 < rounds:
            rows = assigned.groupBy("c").agg(*[F.avg(a).alias(a) for a in axes]).collect()
            centres = spark.createDataFrame([tuple(r) for r in rows], schema)
    return assigned
