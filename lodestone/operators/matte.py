"""Cleanup of rasters: flood, matte growth, feathering, seams, spikes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import column, row, with_cross


def down():
    return Window.partitionBy("img_id", F.expr("x - y")).orderBy("x")


def up():
    return Window.partitionBy("img_id", F.expr("x + y")).orderBy("x")


def flood(px: DataFrame, passable: Column, seeds: Column, checkpoint, most_rounds: int = 4096) -> DataFrame:
    """Adds ``hit``: pixels reached from the seeds through passable ones by steps along rows and
    columns. A round spreads along whole rows and columns at once, so rounds follow the number of
    turns of a path, not its length."""
    now = checkpoint(px.withColumns({"ok": passable, "hit": passable & seeds}))
    total = -1
    for _ in range(most_rounds):
        step = now
        for w, key in ((row(), "y"), (column(), "x")):
            # stretches of passable pixels between two that are not
            step = step.withColumn("stretch", F.sum((~F.col("ok")).cast("int")).over(w))
            step = step.withColumn("hit", F.col("ok") & F.bool_or(F.col("ok") & F.col("hit")).over(Window.partitionBy("img_id", key, "stretch")))
        now = checkpoint(step.drop("stretch"))
        new_total = now.agg(F.count_if("hit")).first()[0]
        if new_total == total:
            return now.drop("ok")
        total = new_total
    raise RuntimeError("the flood did not settle")


def keep_factor(distance: Column, tolerance: float, feather: float) -> Column:
    """0 within the tolerance, 1 beyond the feather, a ramp between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - tolerance) / feather))


def feathered(px: DataFrame, value: str, radius: int, passes: int = 3) -> DataFrame:
    for w in (row(), column()):
        for _ in range(passes):
            px = px.withColumn(value, F.avg(value).over(w.rowsBetween(-radius, radius)))
    return px


def grown(px: DataFrame, alpha: str, carried: list[str], radius: int) -> DataFrame:
    """Largest alpha in reach, with what the pixel that has it carries; on a tie the pixel's own,
    else the first. Rows first, then columns."""
    for w, at in ((row(), "x"), (column(), "y")):
        frame = w.rowsBetween(-radius, radius)
        px = px.withColumn("__best", F.max(F.struct(F.col(alpha).alias("a"), (-F.col(at)).alias("first"), *carried)).over(frame))
        take = F.col("__best.a") > F.col(alpha)
        px = px.withColumns({c: F.when(take, F.col(f"__best.{c}")).otherwise(F.col(c)) for c in carried} | {alpha: F.greatest(F.col(alpha), F.col("__best.a"))})
        px = px.drop("__best")
    return px


def seams(px: DataFrame, opaque: Column, value: str, slack: float) -> DataFrame:
    """Adds ``seam``: an opaque run of at most three pixels along one of four lines whose flanks are
    not opaque and whose value lies, within ``slack``, on the straight line between the flanks'."""
    px = px.withColumn("__o", opaque)
    found = []
    for w in (row(), column(), down(), up()):
        for size in (1, 2, 3):
            for at in range(size):
                before, after = at + 1, size - at
                run = reduce(Column.__and__, [F.lag("__o", k).over(w) if k > 0 else F.lead("__o", -k).over(w) if k < 0 else F.col("__o") for k in range(at, at - size, -1)])
                flanks = ~F.lag("__o", before).over(w) & ~F.lead("__o", after).over(w)
                a, b = F.lag(value, before).over(w), F.lead(value, after).over(w)
                blend = a + (b - a) * (before / (size + 1))
                found.append(F.coalesce(run & flanks & (F.abs(F.col(value) - blend) <= slack), F.lit(False)))
    return px.withColumn("seam", reduce(Column.__or__, found)).drop("__o")


def healed(px: DataFrame, limit: float, passes: int) -> DataFrame:
    """Pixels of another label than a neighbour whose level is within ``limit`` take the label of
    the nearest level, the lowest label of several; a pass reads what stood before it."""
    for _ in range(passes):
        for c in ("label", "v"):
            px = with_cross(px, c).withColumnsRenamed({n: f"{n}_{c}" for n in "lrud"})
        near = F.array(*[F.when(F.abs(F.col(f"{n}_v") - F.col("v")) <= limit, F.struct(F.abs(F.col(f"{n}_v") - F.col("v")).alias("d"), F.col(f"{n}_label").alias("label"))) for n in "lrud"])
        same = F.exists(F.array(*[F.col(f"{n}_label") for n in "lrud"]), lambda x: x == F.col("label"))
        best = F.array_min(F.array_compact(near))["label"]
        px = px.withColumn("label", F.when(F.coalesce(same, F.lit(False)), F.col("label")).otherwise(F.coalesce(best, F.col("label"))))
        px = px.drop(*[f"{n}_{c}" for n in "lrud" for c in ("label", "v")])
    return px


def routed(routes: DataFrame, checkpoint, most_rounds: int = 64) -> DataFrame:
    """(id, to_) with every route followed to its end. Members of a cycle route nowhere, and routes
    into a cycle end at the member they reach. ``checkpoint`` cuts the lineage of a round.

    First each node's jumps of doubling length tell which nodes come back to themselves: after as
    many doublings as it takes to pass all nodes, what is still reached lies on a cycle."""
    n = max(1, routes.count())
    jump = checkpoint(routes.select("id", "to_"))
    step = 1
    while step < n:
        ahead = jump.select(F.col("id").alias("to_"), F.col("to_").alias("further"))
        jump = checkpoint(jump.join(ahead, "to_").select("id", F.col("further").alias("to_")).where("to_ is not null"))
        step *= 2
    on_cycle = jump.select(F.col("to_").alias("id")).distinct()
    # every member of a cycle is reached from some member of it by a jump of any length
    ends = routes.join(on_cycle, "id", "left_anti").select("id", "to_")
    now = checkpoint(ends.unionByName(on_cycle.withColumn("to_", F.lit(None).cast("long"))))
    for _ in range(most_rounds):
        ahead = now.where("to_ is not null").select(F.col("id").alias("to_"), F.col("to_").alias("further"))
        nxt = checkpoint(now.join(ahead, "to_", "left").select("id", F.coalesce("further", "to_").alias("to_"), F.col("further").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("id", "to_")
        now = nxt.select("id", "to_")
    raise RuntimeError("routes did not settle")
