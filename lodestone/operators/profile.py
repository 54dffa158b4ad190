"""Colour profiles along a gradient: bins, splitting where they leave the straight line, and stops by
least squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(samples: DataFrame, key: list[str], values: list[str], bins: int) -> DataFrame:
    """(key, i, t, values): means of the samples (key, t from 0 to 1, values) in equal bins of t."""
    i = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("t") * bins))).cast("int").alias("i")
    return samples.groupBy(*key, i).agg(*[F.avg(c).alias(c) for c in ("t", *values)])


def split(points: DataFrame, key: list[str], values: list[str], distance, tolerance: float, checkpoint, most_rounds: int = 200) -> DataFrame:
    """The points (key, i, t, values) that stay when each key's line is split at the point farthest
    from its chord for as long as one is over the tolerance. ``distance`` takes the columns of a point
    and of the chord at its t. All stretches of all keys are split in one round, so there are as many
    rounds as splits lie within each other; of equally far points the first is taken."""
    order = Window.partitionBy(*key).orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (F.col("i") == F.min("i").over(whole)) | (F.col("i") == F.max("i").over(whole))
    now, count = checkpoint(points.withColumn("kept", ends)), -1
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("kept"), F.struct("i", "t", *values))
    a, b = F.col("__from"), F.col("__to")
    share = (F.col("t") - a["t"]) / F.when(b["t"] == a["t"], 1.0).otherwise(b["t"] - a["t"])
    chord = {f"__on_{c}": a[c] + (b[c] - a[c]) * share for c in values}
    for _ in range(most_rounds):
        found = now.agg(F.count_if("kept")).first()[0]
        if found == count:
            return now.where("kept").drop("kept")
        count = found
        s = now.withColumns({"__from": F.last(mark, True).over(before), "__to": F.first(mark, True).over(after)})
        s = s.withColumns(chord).withColumn("__away", F.when(~F.col("kept"), distance([F.col(c) for c in values], [F.col(c) for c in chord])))
        stretch = Window.partitionBy(*key, "__from.i")
        # rows of kept points carry a null distance, which is below all others
        far = F.max(F.struct(F.col("__away").alias("away"), (-F.col("i")).alias("early"))).over(stretch)
        over = (F.col("__away") > tolerance) & (-F.col("i") == F.col("__far.early"))
        s = s.withColumn("__far", far).withColumn("kept", F.col("kept") | F.coalesce(over, F.lit(False)))
        now = checkpoint(s.select(*points.columns, "kept"))
    raise RuntimeError(f"lines still split after {most_rounds} rounds")


def _tridiagonal(diagonal: Column, beside: Column, right: Column) -> Column:
    """The solution of a symmetric system with one band beside the diagonal: forward elimination and
    back substitution as folds over arrays."""
    numbers = F.sequence(F.lit(0), F.size(diagonal) - 1)
    none = F.array().cast("array<double>")
    get = lambda c, k: F.get(c, k)

    def down(state: Column, k: Column) -> Column:
        over = F.when(k > 0, get(beside, k - 1)).otherwise(0.0)
        pivot = get(diagonal, k) - over * F.when(k > 0, F.element_at(state["c"], -1)).otherwise(0.0)
        c = F.coalesce(get(beside, k), F.lit(0.0)) / pivot
        d = (get(right, k) - over * F.when(k > 0, F.element_at(state["d"], -1)).otherwise(0.0)) / pivot
        return F.struct(F.array_append(state["c"], c).alias("c"), F.array_append(state["d"], d).alias("d"))

    start = F.struct(none.alias("c"), none.alias("d"))

    def up(state: Column) -> Column:
        pairs = F.reverse(F.arrays_zip(state["c"], state["d"]))
        return F.aggregate(pairs, none, lambda x, p: F.concat(F.array(p["d"] - p["c"] * F.coalesce(F.get(x, F.lit(0)), F.lit(0.0))), x))

    return F.aggregate(numbers, start, down, up)


def stops(samples: DataFrame, profile: DataFrame, key: list[str], values: list[str], ridge: float = 1e-6) -> DataFrame:
    """(key, j, t, values): the stops at the places of ``profile`` (key, i, t, values) whose straight
    lines fit the samples best. The first stop moves to 0 and the last to 1; a profile of one point
    has its values at both. ``ridge`` times the number of samples ties a stop to the profile, so one
    that no sample reaches stays there. Values end between 0 and 255.

    Samples add up hat functions per stretch, five sums and two for each value, so what is gathered of
    a key is its stops alone."""
    knot = F.struct("t", *values)
    k = profile.groupBy(*key).agg(F.array_sort(F.collect_list(knot)).alias("p"))
    k = k.withColumn("p", F.when(F.size("p") == 1, F.array_repeat(F.get("p", F.lit(0)), 2)).otherwise(F.col("p")))
    place = lambda x, n: F.when(n == 0, 0.0).when(n == F.size("p") - 1, 1.0).otherwise(x["t"])
    k = k.withColumn("at", F.transform("p", place))
    t = F.col("t")
    s = samples.join(k.select(*key, "at"), key)
    s = s.withColumn("seg", F.size(F.filter(F.slice("at", F.lit(2), F.size("at") - 2), lambda x: x < t)))
    low, high = F.get("at", F.col("seg")), F.get("at", F.col("seg") + 1)
    s = s.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - low) / F.when(high == low, 1.0).otherwise(high - low))))
    u, w = 1 - F.col("w"), F.col("w")
    sums = {"n": F.count("*"), "uu": F.sum(u * u), "ww": F.sum(w * w), "uw": F.sum(u * w)}
    sums |= {f"{side}_{c}": F.sum(x * F.col(c)) for c in values for side, x in (("u", u), ("w", w))}
    part = s.groupBy(*key, "seg").agg(*[f.cast("double").alias(n) for n, f in sums.items()])
    table = part.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("seg"), F.struct(*sums)))).alias("m"), F.sum("n").alias("n")).join(k, key)
    numbers = F.sequence(F.lit(0), F.size("at") - 1)
    of = lambda seg, name: F.coalesce(F.try_element_at("m", seg)[name], F.lit(0.0))
    hold = ridge * F.col("n")
    diagonal = F.transform(numbers, lambda j: of(j, "uu") + of(j - 1, "ww") + hold)
    beside = F.transform(numbers, lambda j: of(j, "uw"))

    def right_of(c: str) -> Column:
        return F.transform(numbers, lambda j: of(j, f"u_{c}") + of(j - 1, f"w_{c}") + hold * F.get("p", j)[c]).alias(f"r_{c}")

    # the arrays become columns first: the folds read each of them many times
    table = table.select(*key, "at", diagonal.alias("diagonal"), beside.alias("beside"), *map(right_of, values))
    solved = [_tridiagonal(F.col("diagonal"), F.col("beside"), F.col(f"r_{c}")).alias(c) for c in values]
    out = table.select(*key, "at", *solved)
    rows = F.posexplode(F.arrays_zip("at", *values)).alias("j", "s")
    fit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(f"s.{c}"))).alias(c)
    return out.select(*key, rows).select(*key, "j", F.col("s.at").alias("t"), *[fit(c) for c in values])
